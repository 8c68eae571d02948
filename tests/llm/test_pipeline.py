import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gainsieve.llm import queries
from gainsieve.llm.quality import quality_scores
from tests.check import compare, connect
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, con: duckdb.DuckDBPyConnection, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SF) is None


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, len(queries.QUERIES) + 1)]
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        bad = {r["doc_id"] for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r["predicted"]} if not steps else set()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect() or [], stage(spark, docs, SF).schema)
        steps[name] = before, {r["doc_id"]: r for r in docs.collect()}, bad
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    before, after, bad = steps["quality classifier"]
    assert set(after) == set(before) - bad and bad
    before, after, _ = steps["line dedup"]
    assert set(after) == set(before)
    before, after, _ = steps["SimHash near-dedup"]
    ids = sorted(before)
    groups = brute_groups([brute_fingerprint(before[i]["text"]) for i in ids], 4)
    assert set(after) == {ids[g] for g in groups}
    before, after, _ = steps["benchmark decontamination"]
    hit = {r[0] for r in brute([(i, before[i]["text"]) for i in before], items) if r[-1]}
    assert set(after) == set(before) - hit
    before, after, _ = steps["mixing sources to target weights"]
    assert set(after) == set(before) and sum(r["taken"] for r in after.values()) > 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
