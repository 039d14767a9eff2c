"""Plans: what is read, and that narrow operators don't shuffle."""

from pathlib import Path

import pytest

from quillspark.functions import native, pytext
from quillspark.operators import analyze, lint, readability
from quillspark.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    d = table(spark, DATA, "documents")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(d.select("doc_id", native.word_count("text").alias("n")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(lint.lint(d))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,90)]" in plan(table(spark, DATA, "documents").where("doc_id > 90").select("doc_id"))


def test_scores_need_no_shuffle_and_one_evaluation(spark):
    s = plan(readability.scores(analyze.analyze(table(spark, DATA, "documents").select("doc_id", "text"), "text"), keep=["doc_id"]))
    assert "Exchange" not in s and s.count("ArrowEvalPython") == 1


def test_native_tokens_equal_the_scanner(spark):
    rows = table(spark, DATA, "documents").select("text", native.tokens("text").alias("t")).collect()
    assert rows and all((r.t or []) == pytext.words(r.text) for r in rows)


def test_native_syllables_equal_the_kernel(spark):
    words = sorted({w for r in table(spark, DATA, "documents").select("text").collect() for w in pytext.words(r.text)})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", native.syllables_en("w").alias("e"), native.syllables_de("w").alias("d"))
    assert [r for r in df.collect() if (r.e, r.d) != (pytext.syllables(r.w, "en"), pytext.syllables(r.w, "de"))] == []
