import json

import pytest

from quillspark.functions import sql
from quillspark.sinks import report
from quillspark.sources import datasource, remote
from quillspark.sources.errors import TextError


def answer(method, url, body):
    if "scrape" in url:
        return (404, {}, "gone") if "lost" in body["url"] else (200, {}, json.dumps({"success": True, "data": {"markdown": "# Hi", "metadata": {}}}))
    if "tools/search" in url:
        return 200, {}, json.dumps({"tools": [{"id": "a/b"}]})
    if "tools/" in url:
        return 200, {}, json.dumps({} if body.get("q") == "none" else {"items": [1, 2]})
    return 200, {}, json.dumps({"title": "Ada", "extract": "e"})


def test_sql_functions(spark):
    assert len(sql.register(spark)) == 7
    spark.createDataFrame([(1, "One here. Zwei ä. Three was taken."), (2, None)], "id int, text string").createOrReplaceTempView("docs")
    rows = spark.sql("select d.id, s.* from docs d, lateral quill_sentences(d.text) s order by id, sent").collect()
    assert [(r.id, r.sent_text, r.words) for r in rows] == [(1, "One here.", 2), (1, "Zwei ä. Three was taken.", 5)]
    assert spark.sql("select sum(t.syllables) from docs d, lateral quill_tokens(d.text, 'en') t").first()[0] == 8
    assert {r.rule for r in spark.sql("select f.rule from docs d, lateral quill_lint(d.text, 'en') f").collect()} >= {"passive"}
    assert spark.sql("select quill_detect(text) d, quill_sniff('# x') s, quill_strip('# h') t, round(quill_ease('The cat sat.', 'en'), 2) e from docs where id = 1").first()[:] == ("de", "markdown", "h.", 119.19)


def test_data_sources(spark):
    datasource.register(spark)
    read = lambda f: spark.read.format(f).option("transport", "test_sql_and_sources:answer").option("base_url", "http://s/{lang}")
    got = {r.requested_url: r for r in read("quill_pages").option("urls", "a.org\n\nlost.org\na.org").option("batch", "1").load().collect()}
    assert got["a.org"].markdown == "# Hi" and got["lost.org"].error.startswith("not_found") and len(got) == 2
    assert [r.title for r in read("quill_articles").option("titles", "ada").load().collect()] == ["Ada"]


def test_tools(spark):
    t = remote.DataTools(answer, "http://d")
    assert t.find("q") == [{"id": "a/b"}]
    with pytest.raises(TextError):
        t.run("nope", {})
    got = {r.options: r for r in remote.run_tool(spark.createDataFrame([('{"q":"x"}',), ('{"q":"none"}',), ('{"q":"x"}',)], "options string"), t, "a/b").collect()}
    assert json.loads(got['{"q":"x"}'].response) == {"items": [1, 2]} and got['{"q":"none"}'].error["code"] == "not_found" and len(got) == 2
    assert remote.parse_option("a=[1]") == ("a", [1]) and remote.parse_option("b=x=y") == ("b", "x=y")
    with pytest.raises(TextError):
        remote.parse_option("novalue")


def test_reports():
    f = [{"id": 1, "rule": "filler", "start": 5, "end": 9, "sentence": 2, "message": "m", "excerpt": "a  b"}, {"id": 1, "rule": "sentence-length-variance", "start": 0, "end": 0, "sentence": 0, "message": "n", "excerpt": ""}]
    assert report.findings(f, {1: "äx\n\nyyyy"}) == "1: 2 findings\n  filler (1)\n    L3: m a b\n  sentence-length-variance (1)\n    document: n\n"
    assert "↑" in report.differences([{"metric": "flesch", "before": 1.0, "after": 2.0, "delta": 1.0, "improved": True}])
    assert report.scores([{"id": "d", "metric": "lix", "score": 30.0, "level": "easy"}]) == "d\n  lix: 30 (easy)\n" and report.shorten("a b c d", 4) == "a b…"
