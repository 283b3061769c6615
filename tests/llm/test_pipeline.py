import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import lines, rules
from tests.llm.data import CLASHES, documents, key
from tests.llm.test_dedup import crowded_sentences, jaccard, shared_docs, shingles

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "substring_dedup", "packing"]


def test_stages_take_effect_and_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    found = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        found.append(docs)
        assert k == 4 or docs.columns == columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = con.sql(f"SELECT doc_id FROM ({rules.oracle()}) WHERE kept").fetchall()
    assert sorted(r[0] for r in found[0].select("doc_id").collect()) == sorted(r[0] for r in good)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/0/*.parquet'")
    cut = con.sql(f"SELECT doc_id, text FROM ({lines.oracle()})").fetchall()
    assert sorted((r["doc_id"], r["text"]) for r in found[1].collect()) == sorted(cut)
    rows = {r["doc_id"]: shingles(r["text"]) for r in found[1].collect()}
    kept = {r["doc_id"] for r in found[2].collect()}
    near = {i: [j for j in rows if j != i and jaccard(rows[i], rows[j]) >= 0.7] for i in rows}
    assert all(i in kept or near[i] for i in rows)
    assert sum(i in kept and any(j in kept and jaccard(rows[i], rows[j]) >= 0.8 for j in near[i]) for i in rows) <= 0.02 * len(rows)
    before = {r["doc_id"]: r["text"] for r in found[2].collect()}
    after = {r["doc_id"]: r for r in found[3].collect()}
    assert all(len(after[i]["text"]) <= len(before[i]) and after[i]["n_chars"] == len(after[i]["text"]) for i in after)
    total = {}
    for r in found[4].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= total[r["doc_id"]]
    assert set(total) == set(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()), key=key) == sorted(
        map(tuple, found[4].drop("sequence_id", "offset").collect()), key=key
    )


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_extra_columns_and_bear_trouble(spark, empty):
    docs = documents(spark).limit(0) if empty else documents(spark).unionByName(documents(spark, [(200 + i, t, s) for i, t, s in shared_docs()[0]]))
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup" and not empty:  # what the rules reject is trouble for the others
            docs = spark.createDataFrame(rows, docs.schema)
        out = stage(spark, docs, SF)
        if name == "packing":
            assert (out.count() == 0) == empty
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
            known = {(r["doc_id"], r["text"]): r for r in docs.collect()}
            for r in out.collect():
                assert all(r[c] == f"{c} of {r['doc_id']}" for c in CLASHES) and (r["shard"], r["fp"], r["__fp2"]) == (7, 7, "y")
                old = known.get((r["doc_id"], r["text"]))
                assert r == old if old is not None else r["n_chars"] == len(r["text"])
            docs = out


def test_a_passage_in_a_crowd_stays_once(spark):
    left = {r["doc_id"]: len(r["text"].split()) for r in corpus_pipeline.substring_dedup(spark, documents(spark, crowded_sentences()), SF).collect()}
    assert left[40] == 140 and all(left[i] <= 64 for i in (41, 42, 43)) and all(n == 100 for i, n in left.items() if not 40 <= i <= 43)
