"""The registered queries against their SQL, and the pipeline as a whole."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrylens.llm.queries import ORACLES, QUERIES
from quarrylens.session import materialize

from .fixtures import awkward, frame, prose


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    result = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    back = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    mine = sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(r[i] for i in back) for r in result.fetchall()), key=repr)


def test_all_operators_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data))
        assert docs.columns == columns
        assert 0 < docs.count() <= left, name
        left = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, data).select("doc_id").collect()}
    assert packed == ids
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()}
    assert run == ids


@pytest.mark.parametrize("rows", [[], awkward()])
def test_pipeline_takes_awkward_rows(spark, data, rows):
    docs = frame(spark, rows)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data))
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) or None in ids
    corpus_pipeline.packing(spark, docs, data).collect()


def test_near_dedup_keeps_one_of_repeated_rows(spark, data):
    docs = frame(spark, awkward())
    kept = corpus_pipeline.near_dedup(spark, docs, data).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(ids)) and 16 in ids and 17 not in ids
    assert [r["text"] for r in kept if r["doc_id"] is None] == [None]  # the other one is a copy of document 1


def test_stages_go_by_rows_and_not_by_ids(spark, data):
    """Rows that share an id, or have none, are judged by their own texts."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 100").first()["text"]
    leak, clean, copied = f"so it says {item} and more", prose(31, 90), prose(32, 90)
    rows = [(1, clean), (1, leak), (None, leak), (None, prose(33, 90)), (2, copied), (3, copied), (3, prose(34, 90)), (None, copied), (4, None)]
    docs = frame(spark, rows)
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, data).collect()}
    assert left == {r for r in rows if r[1] != leak}
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
    assert left == set(rows) - {(None, leak), (3, copied), (None, copied)}
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, data).collect()}
    assert left == set(rows) - {(None, leak), (3, copied), (None, copied)}
