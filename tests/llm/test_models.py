import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, quality_model, sharding
from tests.llm.data import documents, key, plain


def need(sizes, capacity):
    used, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return len(sizes) + 1
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used


def optimum(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(sizes, middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize(("first", "more"), [(3, 2), (14, 7)])
def test_capacity_is_the_smallest(spark, monkeypatch, first, more):
    monkeypatch.setattr(sharding, "FIRST", first)
    monkeypatch.setattr(sharding, "MORE", more)
    rng = random.Random(first)
    for shards, n in ((5, 60), (24, 200), (24, 10)):
        places = sorted(rng.sample(range(1 << sharding.PLACE), n))
        sizes = [rng.choice([1, 5, 9, rng.randint(1, 300)]) for _ in places]
        df = spark.createDataFrame(list(zip(places, sizes, strict=True)), "place long, size long")
        cuts, capacity = sharding.cut_places(df, shards)
        assert capacity == optimum(sizes, shards)
        by = {}
        for p, s in zip(places, sizes, strict=True):
            k = bisect.bisect_right(cuts, p)
            by[k] = by.get(k, 0) + s
        assert max(by.values()) <= capacity and max(by) < shards


def test_shards(spark):
    rng = random.Random(1)
    hot = "hot text " * 50
    rows = [(k, hot if k % 3 == 0 else "w" * rng.randint(0, 200), "s") for k in range(600)]
    docs = documents(spark, rows).unionByName(documents(spark))
    got = sharding.shard(docs, 8).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in plain(docs)), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    by, sizes = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        assert 0 <= r["shard"] < 8
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    one = {}
    for r in got:
        one.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in one.values())
    rest = sorted(sizes.values())[:-2]  # the hot text and one very long text stand alone
    assert max(rest) < 1.5 * sum(rest) / 6 and min(rest) > 0.5 * sum(rest) / 6
    assert sharding.shard(docs.limit(0)).count() == 0


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, list int, entry int").repartition(3)


def test_neighbours_with_every_list_searched_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "COVERED", 1.0)
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    same = rows[0][1]
    rows += [(1000 + k, same) for k in range(40)] + [(100, rows[100][1])]
    bad = [(3000, None), (3100, [0.0] * 8), (3200, [1.0] * 7 + [None]), (3300, [1.0] * 7 + [float("nan")]), (3400, [float("inf")] * 8), (3500, [1.0] * 3), (None, same)]
    got = ann.neighbours(embeddings(spark, rows + bad), every=100).collect()
    known = {i: np.array(v, np.float64) for i, v in rows}
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(by) == {i for i in known if i % 100 == 0}
    for q, found in by.items():
        far = sorted((float(np.sqrt(((v - known[q]) ** 2).sum())), i) for i, v in known.items() if i != q)[:10]
        assert [f[2] for f in found] == list(range(1, 11))
        assert [f[0] for f in found] == [i for _, i in far]
        assert [f[1] for f in found] == pytest.approx([d for d, _ in far], abs=1e-12)
    few = ann.neighbours(embeddings(spark, rows[:4]), every=1).collect()
    assert len(few) == 12
    assert ann.neighbours(embeddings(spark, [])).count() == ann.neighbours(embeddings(spark, bad)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 16))).astype(np.float32)
    got = ann.neighbours(embeddings(spark, list(enumerate(x.tolist()))), every=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in by.items():
        far = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(found & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert len(by) == 250 and hits / 2500 >= 0.9


def test_trees_learn_and_traverse_alike():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_model.grow(x[:500], y[:500], trees=30)
    score = model.score(x[500:])
    assert ((score > 0.5) == (y[500:] > 0)).mean() > 0.93
    for row, s in zip(x[500:520], score, strict=False):
        total = model.start
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality_model.grow(np.empty((0, 5)), np.empty(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert set(quality_model.grow(x[:9], np.ones(9)).score(x).tolist()) == {10 / 11}


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert got.where("score < 0 OR score > 1 OR predicted != CAST(score >= 0.3 AS int)").count() == 0


def test_scores_of_troublesome_documents(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.classify(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.classify(docs, odd).collect()} == {0.5}
    assert quality_model.classify(docs.where(F.lit(False)), none).count() == 0


@pytest.mark.parametrize("kind", ["scales", "apart"])
def test_neighbours_of_uneven_vectors_are_found(kind):
    """Vectors of many lengths, whose codes tell short ones apart badly; queries that lie elsewhere."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, d, k = 4000, 32, 10
    asked = np.arange(0, n, 50)
    if kind == "scales":
        x = rng.normal(size=(n, d)) * np.exp(3 * rng.normal(size=(n, 1)))
    else:
        x = rng.normal(size=(60, d))[rng.integers(0, 60, n)] + 0.05 * rng.normal(size=(n, d))
        x[asked] = rng.normal(size=(len(asked), d))
    index = ann.fit(x, 128)
    own, codes = index.encode(x)
    probes = ann.probes_for(index, x, k, ann.COVERED, x[asked])
    near = np.argsort(ann.squares(x[asked], index.centers), 1)[:, :probes]
    vectors = lambda rows: pa.array(rows.tolist(), pa.list_(pa.float64()))
    queries = pa.table({"query": asked, "vector": vectors(x[asked]), "lists": pa.array(near.tolist(), pa.list_(pa.int32()))})
    entries = pa.table({"list": own.astype(np.int32), "entry": np.arange(n), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "vector": vectors(x)})
    found = ann.search_block(index, k + 1, queries, entries).to_pylist()
    got = {(r["query"], r["entry"]) for r in found}
    hits, inside = 0, 0
    for i, q in enumerate(asked.tolist()):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        true = np.argsort(far)[:k]
        hits += sum((q, int(v)) in got for v in true)
        inside += int(np.isin(own[true], near[i]).sum())
    assert hits == inside >= 0.95 * k * len(asked)
