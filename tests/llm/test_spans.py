import random
from collections import defaultdict

import pytest

from argosift.llm import spans as S


def brute(rows, length):
    where = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            where[t[k : k + length]].add(i)
    return {(a, b) for ids in where.values() for a in ids for b in ids if a < b}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé𝛼 ") for _ in range(rng.randrange(2, 9)))
    shared = ["".join(word() for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(word() for _ in range(rng.randrange(0, 12)))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            low = rng.randrange(0, max(1, len(s) - 35))
            parts += [s[low : low + rng.randrange(20, 60)], word()]
        rows.append((f"id{i}", "".join(parts)))
    return rows + [rows[3], ("copy", rows[5][1]), ("long", shared[0] * 30), ("x", None), ("y", ""), (None, shared[0])]


def test_covers():
    for period, cover in S.DIFFERENCE_COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("length", [30, 41])
def test_pairs_against_brute_force(spark, length):
    rows = corpus(length)
    texts = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id string, text string, class string").select("id", "text")
    members, sets, _ = S.shared_spans(texts, length)
    got = {tuple(r) for r in S.pairs_of_ids(members, S.links(sets)).collect()}
    want = brute([r for r in rows if r[0] is not None], length)
    assert got == want and want
    met = defaultdict(set)
    for r in S.memberships(members, sets).collect():
        for name in [("class", r["class_id"]), *r["passages"]]:
            met[name].add(r["id"])
    assert {(a, b) for ids in met.values() for a in ids for b in ids if a < b} == want


def test_share(spark):
    rows = corpus(9)
    texts = spark.createDataFrame(rows, "id string, text string").distinct()
    members, _, spans = S.shared_spans(texts, 30)
    got = {r["id"]: r["shared_chars"] for r in S.shared_share(texts, members, spans).collect()}
    plain = {(i, t) for i, t in rows if i is not None}
    for i, t in plain:
        t = t or ""
        covered = set()
        for k in range(len(t) - 29):
            if any(j != i and o and t[k : k + 30] in o for j, o in plain):
                covered |= set(range(k, k + 30))
        assert got[i] == len(covered), i


def test_arrays_stand_for_themselves_and_empty_table(spark):
    a, b = "x" * 20 + "0123456789" * 2, "0123456789" * 2
    units = spark.createDataFrame([("u", [a[:20], b, None]), ("v", [b, ""]), ("w", None)], "id string, ss array<string>")
    texts = S.gather_texts((units, "id", "ss"))
    members, sets, _ = S.shared_spans(texts, 20)
    assert {tuple(r) for r in S.pairs_of_ids(members, S.links(sets)).collect()} == {("u", "v")}
    members, sets, spans = S.shared_spans(texts.limit(0), 20)
    assert S.pairs_of_ids(members, S.links(sets)).count() == 0 and S.shared_share(texts.limit(0), members, spans).count() == 0


def test_share_counts_every_place_of_a_passage(spark):
    shared = "".join(random.Random(3).choices("abcdefgh", k=40))
    rows = [("a", "1" * 9 + shared + "2" * 25 + shared + "3" * 7), *((f"b{i}", str(i) * 12 + shared) for i in range(4, 8)), ("c", "9" * 60)]
    texts = spark.createDataFrame([*rows, ("d", shared[:35] + "0" * 9), ("d", shared[:35] + "5" * 9)], "id string, text string")
    members, _, spans = S.shared_spans(texts, 30)
    got = {r["id"]: r["shared_chars"] for r in S.shared_share(texts, members, spans).collect()}
    assert got == {"a": 80, "b4": 40, "b5": 40, "b6": 40, "b7": 40, "c": 0, "d": 70}


def test_two_texts_of_one_id_share_with_nobody(spark):
    shared = "".join(random.Random(3).choices("abcdefgh", k=40))
    texts = spark.createDataFrame([("a", "1" * 9 + shared), ("a", "2" * 9 + shared), ("b", "3" * 50)], "id string, text string")
    members, sets, spans = S.shared_spans(texts, 30)
    assert sets.count() == 0
    assert {r["id"]: r["shared_chars"] for r in S.shared_share(texts, members, spans).collect()} == {"a": 0, "b": 0}


def test_shares_of_one_passage_are_linear_in_its_texts(spark):
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefgh", k=60))
    for n in (100, 400):
        rows = [(f"t{i:04}", "".join(rng.choices("0123456789", k=40)) + chr(1000 + i) + shared + chr(1000 + i) + "9" * (i % 29)) for i in range(n)]
        members, sets, spans = S.shared_spans(spark.createDataFrame(rows, "id string, text string"), 30)
        assert spans.count() == n and sets.count() == n


def test_hashes_that_stand_for_different_characters_are_told_apart(spark, monkeypatch):
    real = S.window_hashes
    monkeypatch.setattr(S, "window_hashes", lambda codes, starts, width, up, down: real(codes, starts, width, up, down) % 50)
    rows = corpus(30, 12)
    texts = spark.createDataFrame(rows, "id string, text string")
    members, sets, _ = S.shared_spans(texts, 30)
    assert {tuple(r) for r in S.pairs_of_ids(members, S.links(sets)).collect()} == brute([r for r in rows if r[0] is not None], 30)
