import random

from argosift.llm import leakage as L
from argosift.llm.textforms import bare_word, plain

ITEM = "Write exactly one forecast on microhardness following laser powder bed fusion with a margin above 103.9 HV for load-bearing plates"


def found(spark, texts, items=((1, ITEM),), **kw):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, ITEM, 5)], "doc_id long, text string, item_id long")
    asked = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaked_items(docs, asked, **kw).collect()}


def test_disguises(spark):
    half = ITEM.split()
    texts = [
        ITEM.upper(),
        "Noise before. " + " ".join(half).replace("fusion", "<b>fu</b>sion") + " noise after",
        ITEM.replace("fusion", "fu-\n> sion").replace("one", "оne"),  # hyphenated at a quoted line break; Cyrillic o
        ITEM.replace("fi", "ﬁ").replace(" ", " ​"),
        '{"prompt": "' + ITEM.replace(" following", "\\nfollowing") + '"}',
        " ".join(half[10:]) + " in between " + " ".join(half[:9]),  # the halves in the other order
        " ".join(half[:6]),  # too little
        " ".join(w + " really" for w in half),  # no run
        None,
        "",
        "word " * 50_000 + ITEM,
    ]
    assert found(spark, texts) == {(i, 1) for i in (0, 1, 2, 3, 4, 5, 10)}


def test_tiles_do_not_overlap_and_longest_come_first():
    item, doc = list(range(1, 11)), [1, 2, 3, 4, 5, 99, 4, 5, 6, 7, 8, 9, 10]
    tiles = L.tile(item, doc, 3)
    assert tiles[0] == (3, 6, 7) and sum(t[2] for t in tiles) == 10
    assert L.tile([1, 2, 3, 4], [1, 2, 3, 4] * 3, 4) == [(0, 0, 4)]
    assert L.tile([], [1], 4) == [] and L.tile([1, 2], [1, 2], 4) == []


def test_small_filters_and_empty(spark):
    items = [(i, f"item number {i} speaks of alpha{i} beta{i} gamma{i} delta{i}") for i in range(20)] + [(50, None), (51, ""), (52, "two words"), (3, "item number 3 speaks of alpha3 beta3 gamma3 delta3")]
    texts = [t for _, t in items[:20]]
    want = {(i, i) for i in range(20)}
    assert found(spark, texts, items) == found(spark, texts, items, filter_bits=1024) == want
    assert found(spark, [], items) == set()
    assert found(spark, texts, [(9, "")]) == set()


def test_forms():
    assert bare_word("(at.%)") == "at" and bare_word("Hf₀.₃₄") == "hf034" and bare_word("–") == ""
    assert plain("a&amp;b <i>c</i>") == "a&b c"


def brute_tiles(item, doc, least):
    """Greedy string tiling by its definition."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_i[i + k] and free_d[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < least:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_i[best[0] + k] = free_d[best[1] + k] = False


def test_tiling_equals_its_definition():
    rng = random.Random(8)
    for _ in range(200):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 40))]
        doc = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            low = rng.randrange(len(item) + 1)
            doc[rng.randrange(len(doc) + 1) : 0] = item[low : low + rng.randrange(30)]
        assert L.tile(item, doc, 3, search=rng.choice([3, 5, 32])) == brute_tiles(item, doc, 3)


def test_many_items_that_share_a_seed(spark):
    rng = random.Random(9)
    items = [(i, "in the present study we " + " ".join(f"w{rng.randrange(40_000)}" for _ in range(12))) for i in range(5000)]
    texts = [items[i][1] for i in (5, 77, 4000)] + ["in the present study we saw nothing", " ".join(items[9][1].split()[7:])]
    assert found(spark, texts, items) == {(0, 5), (1, 77), (2, 4000), (4, 9)}
