import random

import pytest

from argosift.llm import packing as K


def test_pack_places_everything_within_capacity():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 101) for _ in range(2000)), reverse=True)
    placed = K.pack(sizes, 100, 1.0, 0.01)
    used = {}
    for n, c in zip(sizes, placed, strict=True):
        used[c] = used.get(c, 0) + n
    assert max(used.values()) <= 100 and len(used) <= 1.04 * sum(sizes) / 100
    assert K.pack([], 100, 1, 1) == []


def test_documents(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(0, 300)) for i in range(800)] + [(5000, 2500), (5001, 200), (5001, 200), (5002, 0), (5003, None), (5004, 1000)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, n_tokens int, container string")
    for shard in (2000, 20):
        out = K.pack_documents(df, capacity=200, shard_containers=shard).toPandas()
        assert out["n_tokens"].sum() == sum(n or 0 for _, n in data)
        used = out.groupby("container")["n_tokens"].sum()
        assert used.max() <= 200 and used.sum() / (200 * len(used)) > 0.95
        assert ((out.groupby("container")["n_tokens"].sum() / 200).reindex(out["container"]).to_numpy() - out["fill"]).max() < 1e-5
        whole = out[out["n_pieces"] > 1]
        assert set(whole["doc_id"]) == {i for i, n in data if n and n > 200}
        big = out[out["doc_id"] == 5000].sort_values("piece")
        assert big["token_start"].tolist() == list(range(0, 2500, 200)) and big["n_tokens"].tolist() == [200] * 12 + [100]
        assert len(out[out["doc_id"] == 5001]) == 2 and 5002 not in set(out["doc_id"])
    assert K.pack_documents(df.limit(0)).count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and None not in got and got[4] > 1
