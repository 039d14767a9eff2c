import os

import pytest

from quillspark.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary files")


def corpus(spark):
    rows = [(i, ("mill water level " if i % 3 else "museum winter programme ") * (5 + i % 7), ("big" if i % 3 else "small") if i % 20 else None, 1) for i in range(600)]
    rows += [(1000, None, "big", 1), (1001, "", "big", 1), (1002, "other words entirely here", "unlisted", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 4), ("none", 0.05, 2)], "source_name string, target_share double, max_repeats int")
    drawn, report = mixing.draw(corpus(spark), targets)
    got = {r.source_name: r for r in report.collect()}
    assert abs(got["big"].actual_share - 0.5 / 0.95) < 0.03 and abs(got["small"].actual_share - 0.45 / 0.95) < 0.03 and got["none"].actual_share == 0
    assert got["big"].most_copies == 1 and got["small"].most_copies <= 4
    ids = {r.doc_id for r in drawn.collect()}
    assert not ids & {1000, 1001, 1002} and ids == {r.doc_id for r in mixing.draw(corpus(spark), targets)[0].collect()}


def test_edges(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    drawn, report = mixing.draw(corpus(spark).limit(0), targets)
    assert drawn.count() == 0 and report.first().actual_share == 0
    assert mixing.draw(corpus(spark), targets.limit(0))[0].count() == 0


def test_tokens_are_the_vocabulary_s():
    count = mixing.counter(mixing.VOCABULARY)
    assert count("") == 0 and 1 <= count("hello world") <= 11 and count("ab " * 50) > 20


def test_memberships_are_soft_and_honest():
    words = [("a", "mill water level"), ("b", "museum winter programme")]
    told = mixing.Bayes(["a", "b"], [(k, f"{w} x{i}") for k, w in words for i in range(60)])
    m = told.membership("a", "museum winter programme")
    assert m[0] > m[1] > 0 and told.membership(None, "museum winter programme")[1] > 0.9 and told.accuracy > 0.9
    mute = mixing.Bayes(["a", "b"], [(k, f"x{i * 7 % 13} y{i % 5}") for i in range(120) for k in ("a", "b", None)], {"a": 30, "b": 10, None: 60})
    p = mute.membership(None, "x1 y2")
    assert abs(p[0] - 0.3) < 0.1 and abs(p[2] - 0.6) < 0.1 and mute.accuracy < 0.8


def test_report_tells_labels_from_guesses(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4)], "source_name string, target_share double, max_repeats int")
    drawn, report = mixing.draw(corpus(spark), targets)
    own = {r.source: r.t for r in drawn.groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    got = {r.source_name: r for r in report.collect()}
    assert all(r.tokens == r.own_tokens + r.guessed_tokens and r.held_out_accuracy > 0.9 and abs(r.expected_share - 0.5) < 0.02 for r in got.values())
    assert got["big"].guessed_tokens > 0 and own[None] > 0
