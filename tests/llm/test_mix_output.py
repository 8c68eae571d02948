from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from gainsieve.llm.mixing import mix, served

SF = "/root/testdata/sf0.001"


def rows():
    """A hot source with a third of all words and weight 1, beside sources most of which are passed twice."""
    hot = [(i, f" hot{i}\n" + "w " * (i % 40), "b") for i in range(600)]
    rest = [(1000 + 20 * k + j, f"s{k}d{j} " + "x\t" * 340, name) for k, name in enumerate("acdefg") for j in range(12)]
    return [*hot, *rest, (None, "no id", "a"), (5, hot[5][1], "b"), (7, hot[8][1], "b"), (9000, None, "b"), (9001, " ", None)]


def test_passes_carry_the_words_that_the_mix_takes(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(4)
    got = served(df).select("*", "mix.*").collect()
    want, had, texts = Counter(), Counter(), defaultdict(list)
    for r in mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    for i, text, _ in rows():
        texts[i].append(text or "")
    for r in got:
        assert len(r["text"].split()) == r["taken"] <= r["size"]
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"]])
        had[r["doc_id"]] += r["taken"]
    assert had == want and sum(r["taken"] == 0 for r in got) > 100
    assert {r["pass"] for r in got} == {0, 1}
    assert sum(0 < r["taken"] < r["size"] for r in got) >= 1
    assert served(df.limit(0)).count() == 0


def test_run_returns_the_mix(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "pass", "taken"} <= set(out.columns)
    got = out.collect()
    assert got and all(0 < r["taken"] == len((r["text"] or "").split()) for r in got)
    target = {r["source"]: r["target"] for r in got}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_columns_with_the_names_of_the_mix_stay(spark):
    names = ["size", "weight", "target", "source_size", "pass", "taken", "finish", "kept", "row", "key", "mix", "a.b"]
    df = spark.createDataFrame([(i, "w " * (i + 1), "s", *range(7, 7 + len(names))) for i in range(9)], ["doc_id", "text", "source", *names])
    got = served(df)
    assert got.columns == [*df.columns, "_mix"]
    assert {tuple(r)[3:-1] for r in got.collect()} == {tuple(range(7, 7 + len(names)))}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("taken", F.lit("mine"))
    assert {r["taken"] for r in corpus_pipeline.source_mix(spark, docs, SF).collect()} == {"mine"}
