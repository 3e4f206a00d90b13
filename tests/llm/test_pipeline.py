import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from growret.llm import queries
from tests.llm.cases import frame, messy_docs, sentence
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def tables(spark, path, docs, labels=(), items=()):
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_act_and_keep_the_columns(spark, tmp_path):
    rows, labels = [], []
    for k in range(240):  # toxic documents, clean ones, and one toxic document without a label
        words = sentence(k, 60, 4000).split()
        if k % 4 == 0:
            words[10:10] = ["scum", "idiot", "vermin"]
        rows.append((k, " ".join(words), "en", "s", 1))
        if k != 120:
            labels.append((k, 1, int(k % 4 == 0)))
    item = sentence(900, 30, 4000)
    rows.append((300, rows[1][1] + " end", "en", "s", 1))  # a near copy of 1
    rows.append((301, rows[2][1], "en", "s", 1))  # an exact copy of 2
    rows.append((302, sentence(901, 50, 4000) + " " + item, "en", "s", 1))  # a leak
    rows.append((303, sentence(902, 50, 4000) + " password=abcdefghijklmnop1 end", "en", "s", 1))
    tables(spark, tmp_path, rows, labels, [(1, item)])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert new.columns == docs.columns and new.schema == docs.schema
        kept.append({r["doc_id"]: r["text"] for r in new.collect()})
        docs = new
    clean = {i for i, *_ in rows if i >= 300 or i % 4}
    assert set(kept[0]) == clean
    want = {i for i, _, c, k in brute([(i, t) for i, t, *_ in rows if i in clean], 5, 80) if k}
    assert set(kept[1]) == want and {300, 301} & want == set()
    assert set(kept[2]) == want - {302}
    assert kept[3].keys() == kept[2].keys() and kept[3][303].endswith("[secret] end")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept[3])


def test_messy_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path / "messy", messy_docs())
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "messy")).collect()}
    assert ids == {1, 2, 3, 4, 5, 6, 9, 10, 11, 12, None}
    tables(spark, tmp_path / "empty", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_every_dealt_query_is_registered():
    runs, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert queries.QUERIES.keys() <= runs.keys() and queries.ORACLES.keys() <= sql.keys() and "pipeline" in runs


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert got.astype(str).sort_values(order).values.tolist() == want.astype(str).sort_values(order).values.tolist()


def test_base_digest_of_secrets_on_the_tables(spark):
    from tests.llm.test_secrets import base

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op10_secrets"](spark, SF).collect():
        found = base(texts[r["doc_id"]])
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in found)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in found) for x in range(3)]


def test_language_and_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs.filter("lang is not null"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


CLASHES = ("_t", "findings", "_base", "_clean", "p_toxic", "is_toxic", "matches", "_kept_id", "_row", "component_id", "_other_0")


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns_they_got(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = frame(spark, extra=CLASHES)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns, name
    rows = got.collect()
    assert rows and all(r[c] == "theirs" for r in rows for c in CLASHES)
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0
    if name != "secrets":
        assert {r["text"] for r in rows} <= {r["text"] for r in docs.collect()}


def test_near_dedup_keeps_the_same_row_whatever_the_order(spark):
    text = sentence(90, 60)
    rows = [(1, text, "en", s, n) for s, n in (("a", 1), ("b", 2), ("c", 3), (None, None))]
    stage = corpus_pipeline.STAGES[1][1]
    kept = [stage(spark, frame(spark, rows[::o]).repartition(p), SF).collect() for o, p in ((1, 1), (-1, 3))]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
