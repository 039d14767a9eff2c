"""Remote services, inputs and encoders that depend on them, over injected transports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import entities, readability
from quillspark.sources import containers, inputs, remote
from quillspark.sources.errors import TextError
from quillspark.streaming import live


def service(method, url, body):
    said = json.dumps(body or {}) + url
    if "broken" in said:
        return 429, {"Retry-After": "7"}, "slow"
    if "scrape" in url:
        return 200, {}, json.dumps({"success": True, "data": {"markdown": "# Hi", "metadata": {"title": "T", "language": "de", "url": body["url"]}}})
    if "summary" in url:
        return 200, {}, json.dumps({"title": "Ada Lovelace", "extract": "e", "titles": {"canonical": "Ada_Lovelace", "normalized": "Ada Lovelace"}})
    if "tools" in url:
        return 200, {}, json.dumps({"tools": [{"id": "a/b", "provider": "a", "capability": "b", "name": "n", "options": [{"key": "q"}], "response": {"about": "x", "key": "items"}}]})
    if "/papers/similar" in url:
        return 200, {}, json.dumps({"papers": [{"paperId": "2", "title": "near"}]})
    if "/papers/" in url and method == "GET":
        return (404, {}, "none") if url.endswith("/9") else (200, {}, json.dumps({"paper": {"paperId": "1", "title": "t", "updateDate": "2024"}}))
    if "sentiment" in url:
        return 200, {}, json.dumps({"languageCode": "en", "documentSentiment": {"score": 0.20000000298, "magnitude": 1.5}, "sentences": [{"text": {"content": "Ada.", "beginOffset": 3}, "sentiment": {"score": -0.5}}]})
    if "categories" in url:
        return 200, {}, json.dumps({"categories": [{"name": "/A/B", "confidence": 0.30000001192}, {"name": "/C", "confidence": 0.9}]})
    return 200, {}, json.dumps({"query": {"search": [{"title": "A", "snippet": "<b>x</b>  &amp;\n y", "size": 3}]}})


def test_titles_snippets_and_failed_searches(spark):
    enc = remote.Encyclopedia(service, "http://{lang}.w")
    asked = spark.createDataFrame([("Ada_Lovelace", "en"), ("ada", "en")], "title string, lang string")
    assert {r.requested: r.aliases for r in api.kb_lookup(asked, enc).collect()} == {"Ada_Lovelace": [], "ada": ["ada"]}
    got = {r.query: r for r in api.kb_search(spark.createDataFrame([("q", "en"), ("broken", "en")], "query string, lang string"), enc).collect()}
    assert got["q"].snippet == "x & y" and got["broken"].error["code"] == "rate_limited" and got["broken"].rank is None
    lit = remote.Literature(service, "http://p")
    failed = api.papers(spark.createDataFrame([("broken",)], "query string"), lit).collect()
    assert len(failed) == 1 and failed[0].error["code"] == "rate_limited"


def test_papers_and_tools(spark):
    lit = remote.Literature(service, "http://p")
    ids = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "paper_id string")
    assert {(r.of_paper, r.rank, r.paper_id) for r in api.related(ids, lit).collect()} == {("1", 1, "2"), ("9", 1, "2")}
    got = {r.requested: r for r in api.inspect(ids, lit).collect()}
    assert got["1"].update_date == "2024" and got["9"].error["code"] == "not_found" and len(got) == 2
    with pytest.raises(TextError):
        api.related(ids, lit, "cousins")
    tools = remote.DataTools(service, "http://d")
    t = api.tools(spark.createDataFrame([("q",)], "query string"), tools).first()
    assert (t.tool_id, json.loads(t.options), t.response_key) == ("a/b", [{"key": "q"}], "items")
    with pytest.raises(TextError):
        tools.run(f"a/{'b' * 201}", {})


def test_sentiment_and_classification(spark):
    words = " ".join(["word"] * 25)
    df = spark.createDataFrame([("1", words), ("2", words), ("3", "few")], "id string, text string")
    p = remote.EntityProvider(service, "http://e", ("sentiment", "categories"))
    got = {r.id: r for r in api.sentiment(df, p).collect()}
    assert len(got) == 3 and (got["1"].score, got["1"].magnitude, got["1"].label, got["1"].language) == (0.2, 1.5, "mixed", "en")
    assert [tuple(x) for x in got["1"].sentences] == [("Ada.", -0.5, 0.0, 3)]
    rows = api.classify(df, provider=p, top=1).collect()
    assert {(r.doc, r.name, r.confidence, r["rank"]) for r in rows} == {("1", "/C", 0.9, 1), ("2", "/C", 0.9, 1)}
    assert entities.parse_sentiment(spark.createDataFrame([("x", "{}")], "id string, response string")).first().label == "neutral"


def test_a_paid_call_is_made_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counted(method, url, body):
        with open(log, "a") as f:
            f.write("x")
        return service(method, url, body)

    df = spark.createDataFrame([(i, "same text") for i in range(6)], "id long, text string")
    got = remote.ask_provider(df, remote.EntityProvider(counted, "http://e", ("sentiment",)), "sentiment", "id")
    assert got.count() == 6 and got.count() == 6 and len(open(log).read()) == 1


def test_addresses_and_several_containers(spark, tmp_path):
    got = {r.id: r for r in api.load(spark, urls=["example.org", "example.org", "http://broken.org"], fetchers=[remote.Fetcher(service, "http://s")]).collect()}
    assert len(got) == 2 and got["0"].text == "# Hi" and got["0"].fields["language"] == "de" and got["1"].error["code"] == "rate_limited"
    with pytest.raises(TextError):
        api.load(spark, urls=["x"], files=["y"], fetchers=[1])
    for n in "ab":
        (tmp_path / f"{n}.rtf").write_bytes(rb"{\rtf1\ansi One " + n.encode() + rb".\par}")
    texts = [r.text.strip() for r in inputs.load(spark, files=[str(tmp_path / "a.rtf"), str(tmp_path / "b.rtf")], kind="container").collect()]
    assert sorted(texts) == ["One a.", "One b."]


def test_rtf_words():
    md, title, _ = containers.rtf(rb"{\rtf1\ansi\uc1{\info{\title The \'c4rger}}{\fonttbl skip}{\*\x skip}\pard\outlinelevel0 Head\par\pard Body \u8364? and \u-10179?\u-8704? {\b bold}\tab x\par \bullet  item\par\trowd a\cell b\cell\row}")
    assert title == "The Ärger" and md.startswith("# Head\n\nBody € and 😀 bold x\n\n- item") and "| a | b |" in md


def test_heading_names():
    assert containers.heading_level("uberschrift1") == 1 and containers.heading_level("encabezado2") == 2


def test_cache_put(spark):
    now = F.to_timestamp(F.lit("2024-01-02"))
    old = dt.datetime(2024, 1, 1, 23)
    cache = spark.createDataFrame([("a", "1", old, 7200), ("b", "2", old, 60), ("c", "3", old, 7200)], "key string, payload string, cached_at timestamp, ttl_seconds int")
    new = spark.createDataFrame([("a", "9", 60), (None, "x", 60), ("d", "4", 0)], "key string, payload string, ttl_seconds int")
    got = {r.key: r.payload for r in entities.put_cached(cache, new, now).collect()}
    assert got == {"a": "9", "c": "3"}


def test_metric_results_are_whole(spark):
    s = spark.createDataFrame([("1", "de", 2, 40, 60, 200, 2, 20, 5), ("2", "en", 2, 40, 60, 200, 2, 20, 5), ("3", "de", 1, 60, 240, 500, 50, 1, 55)], "id string, language string, sentences long, words long, syllables long, characters long, polysyllabic_words long, monosyllabic_words long, long_words long")
    got = {(r.id, r.metric): r for r in readability.scores(s, keep=["id", "language"]).collect()}
    assert (got["1", "amstad"].grade, got["1", "amstad"].scale, got["1", "amstad"].title) == ("7th grade", "0–100, höher ist leichter", "Amstad (Flesch für Deutsch)")
    assert got["2", "smog"].note == "SMOG is calibrated on samples of 30+ sentences; this document has 2, so the score is indicative only."
    w = got["3", "wstf1"]
    assert w.level == "über der Skala" and w.grade == "über der 12. Schulstufe" and w.note.startswith(f"score {w.score} is above the calibrated range 4–15")
    assert all(r.description and r.scale for r in readability.metrics_df(spark).collect())
    api_rows = api.readability(spark.createDataFrame([("1", "The cat sat."), ("1", "The cat sat.")], "id string, text string"), metrics=["flesch"], stats=True)
    assert api_rows.count() == 2 and {"words", "avg_word_length", "grade"} <= set(api_rows.columns)


def test_a_request_does_not_renew_the_time_to_live(spark, tmp_path):
    """The time to live counts from the put; with none left each request is a miss."""
    rows = spark.createDataFrame([("k", "p"), ("k", None)], "key string, payload string")
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r"))
    q = live.cached(stream, 3600).writeStream.outputMode("append").format("memory").queryName("cached_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.payload, r.hit) for r in spark.sql("select payload, hit from cached_rows").collect()) == [("p", False), ("p", True)]
