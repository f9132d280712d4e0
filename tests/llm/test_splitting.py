import random

import pytest

from argosift.llm import splitting as P


def check(text, limit, overlap):
    pieces, forced = P.split_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    for i, (s, c, e) in enumerate(pieces):
        assert e - s <= limit and c - s <= overlap and s <= c
        assert i == 0 or s >= pieces[i - 1][1]
    return pieces, forced


@pytest.mark.parametrize("seed", range(25))
def test_tiles_within_the_limit(seed):
    rng = random.Random(seed)
    sentence = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))) + rng.choice([". ", "? ", "\n", "\n\n", ".", " "])
    text = "".join(sentence() for _ in range(rng.randrange(1, 60)))
    check(text, 80, 15)
    check(text, 30, 10)


def test_forced_only_beyond_the_limit():
    assert check("a" * 80 + "\n" + "b" * 80, 80, 10)[1] is False
    assert check("a" * 81 + "\n" + "b" * 10, 80, 10)[1] is True
    assert check(("word " * 30).strip(), 80, 10)[1] is True
    assert check("x. " * 100, 80, 10)[1] is False


def test_paragraphs_are_kept_before_sentences():
    text = "Aa bb. Cc dd.\n\nEe ff. Gg hh.\n\n"
    pieces, _ = P.split_text(text, 16, 0)
    assert [text[c:e] for _, c, e in pieces] == ["Aa bb. Cc dd.\n\n", "Ee ff. Gg hh.\n\n"]


def test_operator(spark):
    data = [(1, "s", "One two. " * 20), (1, "s", "One two. " * 20), (2, None, "x" * 150), (3, "s", "short"), (4, "s", None), (5, "s", ""), (None, "t", "Long text here. " * 10), (6, "s", "é" * 100)]
    df = spark.createDataFrame([(*r, 7) for r in data], "chunk_id long, section string, text string, piece int")
    out = P.split_oversized(df, limit=100, overlap=10).collect()
    assert {r["chunk_id"] for r in out} == {1, 2, None}
    assert {(r["chunk_id"], r["cut"]) for r in out} == {(1, "natural"), (2, "forced"), (None, "natural")}
    one = sorted((r for r in out if r["chunk_id"] == 1), key=lambda r: r["piece"])
    assert len(one) == one[0]["n_pieces"] and all(len(r["text"]) == r["end"] - r["start"] <= 100 for r in one)
    assert P.split_oversized(df.limit(0)).count() == 0


def test_very_long_text():
    check("A sentence of some length stands here. " * 50_000, 4000, 200)
    check("x" * 1_000_000, 4000, 200)


def test_overlap_is_kept():
    rng = random.Random(1)
    words = " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(4000))
    for text in (words, "x" * 30_000, words.replace("a ", ". "), "Short. " * 3000):
        pieces, _ = P.split_text(text, 1000, 100)
        assert all(50 <= c - s <= 100 for s, c, _ in pieces[1:])
