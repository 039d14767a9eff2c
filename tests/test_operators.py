"""Metrics, rules, entities, encoders and sources on small fixtures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.functions import native, pytext
from quillspark.operators import analyze, entities, lint, readability
from quillspark.sinks import encode
from quillspark.sources import containers, inputs, remote, workspace
from quillspark.sources.errors import TextError, from_status, retry_after

EN = "The cat sat on the mat. It was happy and the dog was chased by nobody."
DE = "Die Prüfung wurde im Rahmen der Sitzung durchgeführt. Das ist eigentlich sehr gut."


def test_analyze_matches_kernel(spark):
    df = spark.createDataFrame([(1, EN, "x"), (2, DE, None), (3, None, "y"), (4, "", "z")], "id int, text string, words string")
    rows = {r["id"]: r for r in analyze.analyze(df, "text").collect()}
    assert rows[1]["language"] == "en" and rows[2]["language"] == "de"
    assert tuple(rows[1][f] for f in pytext.STAT_FIELDS) == pytext.counts(EN, "en")
    assert rows[3]["words"] == 0 and rows[3]["avg_sentence_length"] == 0.0 and rows[4]["sentences"] == 0
    assert analyze.analyze(df.limit(0), "text").collect() == []


def test_native_matches_kernel(spark):
    words = ["make", "table", "Familien", "Straße", "42", "business", "don't", "naïve", "Ferien", "queue"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", native.syllables_en("w").alias("e"), native.syllables_de("w").alias("d"), native.characters("w").alias("c"))
    for r in df.collect():
        assert (r.e, r.d, r.c) == (pytext.syllables(r.w, "en"), pytext.syllables(r.w, "de"), pytext.measure(r.w)), r.w


def stats(spark, **kw):
    base = dict(id=1, language="en", sentences=2, words=20, syllables=30, characters=90, polysyllabic_words=2, monosyllabic_words=12, long_words=4) | kw
    return spark.createDataFrame([tuple(base.values())], "id int, language string, " + ", ".join(f"{k} bigint" for k in list(base)[2:]))


def test_scores(spark):
    got = {r.metric: r for r in readability.scores(stats(spark)).collect()}
    assert sorted(got) == ["ari", "coleman-liau", "flesch", "flesch-kincaid", "gunning-fog", "lix", "smog"]
    assert got["flesch"].score == 69.8 and got["flesch"].level == "standard" and got["flesch"].extra["asl"] == 10
    assert got["lix"].score == 30.0 and got["lix"].level == "easy" and got["smog"].note
    de = {r.metric: r.score for r in readability.scores(stats(spark, language="de")).collect()}
    assert sorted(de) == ["amstad", "lix", "wstf1", "wstf2", "wstf3", "wstf4"] and de["amstad"] == 82.3
    assert readability.scores(stats(spark, words=0)).collect() == []


def test_selection_and_gates(spark):
    assert [m.name for m in readability.resolve(["fre", "flesch", "LIX"])] == ["flesch", "lix"]
    for bad in (["nope"],):
        with pytest.raises(ValueError):
            readability.resolve(bad)
    with pytest.raises(ValueError):
        readability.resolve(["amstad"], "en")
    s = readability.scores(stats(spark))
    assert readability.gate(s, under={"flesch": 70}).count() == 1
    with pytest.raises(ValueError):
        readability.gate(s, over={"flesch": 70})
    v = readability.gate_verdict(s, "id", under={"flesch": 60}).first()
    assert v.passed and not readability.gate_verdict(s.limit(0), "id", under={"flesch": 60}).first().passed
    assert all(m.direction in (readability.UP, readability.DOWN) for m in readability.METRICS.values())


def test_diff(spark):
    d = {r.metric: r for r in readability.diff(stats(spark), stats(spark, syllables=28), "id").collect()}
    assert d["flesch"].improved and d["flesch"].delta == 8.4 and not d["lix"].improved
    assert readability.stats_delta(stats(spark).transform(analyze.with_averages), stats(spark, words=22).transform(analyze.with_averages), "id").first().words == 2


def test_rules():
    en = [(f[0], f[7]) for f in lint.findings(EN)]
    assert ("passive", "was chased") in en
    de = [(f[0], f[7]) for f in lint.findings(DE)]
    assert ("passive", "wurde im Rahmen der Sitzung durchgeführt") in de and ("bureaucratic", "im Rahmen der") in de and ("filler", "sehr") in de
    text = "Äther. " + EN
    for f in lint.findings(text):
        assert text.encode()[f[5]:f[6]].decode() == f[7]
    assert lint.findings("") == [] and lint.findings(None) == []
    assert [f[8] for f in lint.findings("All bbb. All ccc. All ddd. Xxx yyy.", "en", ["repeated-sentence-start"])] == [3.0]
    assert lint.findings("One two three. " * 6, "en", ["sentence-length-variance"])[0][5:7] == (0, 0)
    with pytest.raises(ValueError):
        lint.findings(EN, "en", ["bureaucratic"])
    assert lint.findings("word " * 26, "en", ["long-sentence"])[0][1] == "info" and lint.findings("word " * 36, "en", ["long-sentence"])[0][1] == "warn"
    assert [f[7] for f in lint.findings("The readability number and another readability number.", "en", ["repeated-word"])] == ["readability", "number"]


def test_lint_frame(spark):
    df = spark.createDataFrame([(1, EN), (2, None), (3, DE)], "doc_id int, text string")
    f = lint.lint(df)
    assert lint.filter_severity(f, "warn").where("doc_id = 1").count() >= 1
    assert {r.rule for r in lint.summary(f).where("doc_id = 3").collect()} >= {"passive", "filler"}
    assert lint.rules_df(f.sparkSession).count() == 16


def ent(spark, rows):
    return spark.createDataFrame(rows, "doc int, pos int, name string, type string, salience double, probability double, mentions bigint, wikipedia_url string")


def test_entities(spark):
    e = ent(spark, [(1, 0, "Ada  B", "person", 0.5, 0.0, 2, ""), (1, 1, "ada b", "PERSON", 0.1, 0.0, 1, "u2"), (2, 0, "ADA B", "Person", 0.3, 0.0, 1, "u3"), (2, 1, "Ada B", "WORK", 0.2, 0.0, 1, None), (3, 0, "Z", "OTHER", 0.0, 0.9, 1, None)])
    a = {(r.name, r.type): r for r in entities.aggregate(e).collect()}
    r = a["Ada  B", "PERSON"]
    assert (r.salience, r.avg_salience, r.mentions, r.documents, r.wikipedia_url) == (0.9, 0.45, 4, 2, "u2") and len(a) == 3
    assert entities.filter_score(e, 0.9).count() == 1 and entities.filter_types(e, ["person"]).count() == 3
    assert [x.name for x in entities.top(e, 1).orderBy("doc").collect()] == ["Ada  B", "ADA B", "Z"]
    with pytest.raises(ValueError):
        entities.top(e, 1, "nope")
    assert entities.aggregate(e.limit(0)).count() == 0


def test_enrich_and_keys(spark):
    e = spark.createDataFrame([(1, "https://de.wikipedia.org/wiki/Ada_Lovelace"), (2, "https://example.org/wiki/X"), (3, None)], "doc int, wikipedia_url string")
    art = spark.createDataFrame([("Ada Lovelace", "de", "x"), ("Ada_Lovelace", "de-AT", "y")], "title string, lang string, extract string")
    got = {r.doc: r.article for r in entities.enrich(e, art).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and len(got) == 3
    assert {r.doc: r.article for r in entities.enrich(e, art, limit=0).collect()} == got
    k = spark.createDataFrame([("DOI: 10.1/x ", "fc/People/Lookup", "sk-12345")], "i string, t string, s string").select(native.paper_url("i"), native.tool_id("t"), native.redacted("s"), native.shortened(F.lit("a  b c d e"), 6)).first()
    assert tuple(k) == ("https://doi.org/10.1/x", "fc/people/lookup", "…2345", "a b c…")


def test_bytes(spark):
    df = spark.createDataFrame([("aäöü\nzwei\ndrei",)], "t string")
    assert [r[0] for r in df.select(native.capped("t", 4)).collect()] == ["aä"]
    assert df.select(native.excerpt("t", F.lit(1), F.lit(3)), native.line_number("t", F.lit(9))).first()[:] == ("ä", 2)


def test_toon_and_json():
    data = [{"a": 1, "b": {"c": "x,y", "d": True}}, {"a": 2.0, "b": {"c": "", "d": None}}]
    assert encode.to_toon(data, {"n": 2}) == 'data[2]{a,b{c,d}}:\n  1,"x,y",true\n  2,"",null\nmeta:\n  n: 2\n'
    assert encode.to_toon([1, "two", "3"]) == 'data[3]: 1,two,"3"\nmeta:\n'
    assert encode.to_toon([{"a": 1}, [2, [3]], {}]) == "data[3]:\n  - a: 1\n  - [2]:\n    - 2\n    - [1]: 3\n  -\nmeta:\n"
    assert json.loads(encode.to_json({"x": "<&>"})) == {"data": {"x": "<&>"}, "meta": {}} and "\\u003c" in encode.to_json("<")
    assert encode.to_ndjson([{"a": 9.0}]) == '{"a":9}\n' and encode.to_csv(["a", "b"], [("x,y", [1])]) == 'a,b\n"x,y",[1]\n'
    assert encode.to_table(["a", "bb"], [("xx", 1)]) == "a   bb\n--  --\nxx  1\n"
    assert encode.resolve_format(None, None, True) == "table" and encode.resolve_format("csv", "json", True) == "csv"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/").replace("_DOT_", "."), v)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = zipped(word__document_DOT_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>two</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:t" xmlns:table="urn:tb"'
ODT = zipped(mimetype="application/vnd.oasis.opendocument.text", content_DOT_xml=f'<office:document-content {O}><office:body><office:text><text:h text:outline-level="2">H</text:h><text:p>p<text:s text:c="2"/>q</text:p><text:list><text:list-item><text:p>i</text:p></text:list-item></text:list></office:text></office:body></office:document-content>')
ODS = zipped(mimetype="application/vnd.oasis.opendocument.spreadsheet", content_DOT_xml=f'<office:document-content {O}><office:body><office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>')
PPTX = zipped(ppt__slides__slide2_DOT_xml='<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Two</a:t></a:p></p:sp></p:sld>', ppt__slides__slide10_DOT_xml='<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:t>ten</a:t></a:p></p:sp></p:sld>')
EPUB = zipped(**{"META-INF__container_DOT_xml": '<c><rootfile full-path="o/p.opf"/></c>', "o__p_DOT_opf": '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>', "o__a_DOT_xhtml": "<html><head><title>no</title></head><body><h1>C</h1><p>x &amp; y</p></body></html>"})
RTF = rb"{\rtf1\ansi{\info{\title My}}\pard\outlinelevel0 Head\par\pard Hello \u228?ber \'e4\par}"
PDF = b"%PDF-1.4\n1 0 obj <</Length 9>> stream\nBT /F1 20 Tf 72 700 Td (Title) Tj /F1 10 Tf 0 -40 Td (This is a long line of bo-) Tj 0 -12 Td (dy text here.) Tj ET\nendstream endobj\n"


@pytest.mark.parametrize("name,data,kind,want", [
    ("a.docx", DOCX, "docx", "# Head\n\nOne two\n\n  - item\n\n| a | b |\n"), ("b", DOCX, "docx", "# Head"), ("c", ODT, "odt", "## H\n\np q\n\n- i\n"), ("d", ODS, "ods", "## S\n\n| 1 | x | x |\n"),
    ("e.pptx", PPTX, "pptx", "# Two\n\n- ten\n"), ("f", EPUB, "epub", "# C\n\nx & y\n"), ("g", RTF, "rtf", "# Head\n\nHello äber ä\n"), ("h", PDF, "pdf", "# Title\n\nThis is a long line of body text here.\n"), ("i.txt", "plain ä".encode(), "text", "plain ä"),
])
def test_containers(name, data, kind, want):
    text, title, got, pages = containers.decode(name, data)
    assert got == kind and text.startswith(want), text


def test_container_errors(spark):
    rows = [("a.docx", b"PK junk"), ("b", b"\0\1\2"), ("c.rtf", None), ("d.docx", DOCX)]
    got = {r.path: r for r in containers.extract(spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in rows], "path string, content binary")).collect()}
    assert got["d.docx"].error is None and all(got[k].error["code"] for k in ("a.docx", "b", "c.rtf"))
    assert not containers.is_binary("ä".encode() * 5000)


def test_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "b.jsonl").write_text('{"text": "x", "n": 1, "k": "v"}\n{"text": 5}\n{"no": 1}\nbad\n')
    assert sorted(r.text.strip() for r in inputs.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two"]
    assert sorted(r.id for r in inputs.read_lines(spark, str(tmp_path / "a.txt"), numbered=True).collect()) == ["0", "1"]
    r = inputs.read_text(spark, str(tmp_path / "a.txt")).first()
    assert r.id == "0" and r.text == "one\n\n two \n" and r.fields["file"].endswith("a.txt") and not r.truncated
    rows = inputs.read_jsonl(spark, str(tmp_path / "b.jsonl"), strict=False).collect()
    assert [x.text for x in rows if x.error is None] == ["x"] and rows[0].fields == {"n": "1", "k": "v"} and sum(x.error is not None for x in rows) == 3
    with pytest.raises(Exception):
        inputs.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert [x.text for x in inputs.load(spark, args=["p", "q"]).collect()] == ["p", "q"]
    with pytest.raises(TextError):
        inputs.load(spark)
    capped = inputs.from_args(spark, ["ääää"], cap=3).first()
    assert capped.text == "ä" and capped.truncated


def test_workspace(spark):
    doc = {"documentId": "d", "title": "T", "tabs": [{"tabProperties": {"tabId": "t1", "title": "A"}, "documentTab": {"body": {"content": [
        {"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_1"}, "elements": [{"textRun": {"content": "Head\n"}}]}},
        {"paragraph": {"bullet": {"listId": "l"}, "elements": [{"textRun": {"content": "bold ", "textStyle": {"bold": True}}}, {"textRun": {"content": "x\n"}}]}},
        {"tableOfContents": {}}, {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [{"textRun": {"content": "c\n"}}]}}]}]}]}}]},
        "lists": {"l": {"listProperties": {"nestingLevels": [{"glyphType": "DECIMAL"}]}}}}}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("broken",)], "response string")
    rows = workspace.read_documents(df).collect()
    assert rows[0].text == "# Head\n\n1. **bold** x\n\n| c |\n| --- |" and rows[1].error
    c = spark.createDataFrame([(json.dumps({"comments": [{"id": "1", "content": "a"}, {"id": "2", "content": "b", "deleted": True}, {"id": "3", "content": "c", "resolved": True}]}),)], "response string")
    assert [r.id for r in workspace.comments(c).collect()] == ["1"] and workspace.comments(c, resolved=True).count() == 2
    u = spark.createDataFrame([("https://docs.google.com/document/d/abc_DEF-123/edit",), ("https://docs.google.com/spreadsheets/d/x",), ("a" * 25,), ("no",)], "u string")
    assert [r[0] for r in u.select(workspace.document_id(F.col("u"))).collect()] == ["abc_DEF-123", None, "a" * 25, None]
    assert [r.problem for r in workspace.replacement_check(spark.createDataFrame([("aXbX",), ("a",), ("X",)], "t string"), "t", "X").collect()] == ["ambiguous", "not_found", None]


def test_group_limit_comes_before_the_shuffle(spark):
    e = ent(spark, [(1, i, "x", "T", float(i), 0.0, 1, None) for i in range(20)])
    plan = entities.top(e, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and entities.top(e, 2).count() == 2


def fake(method, url, body):
    if "broken" in json.dumps(body or {}) + url:
        return 429, {"Retry-After": "7"}, "slow"
    if "scrape" in url:
        return 200, {}, json.dumps({"success": True, "data": {"markdown": " # Hi ", "links": ["l"], "metadata": {"title": ["T"], "language": "de-AT", "statusCode": 200, "url": body["url"]}}})
    if "summary" in url:
        return 200, {}, json.dumps({"title": "Ada", "extract": " e ", "lang": "en", "titles": {"canonical": "Ada_L"}, "content_urls": {"desktop": {"page": "p"}}})
    if "papers" in url:
        return 200, {}, json.dumps({"papers": [{"paperId": "1", "title": "t", "ids": {"doi": ["x"]}}]})
    if "entities" in url:
        return 200, {}, json.dumps({"languageCode": "en", "entities": [{"name": "Ada", "type": "PERSON", "salience": 0.61237, "mentions": [{"text": {"content": "Ada", "beginOffset": 0}, "type": "PROPER", "probability": 0.9}], "metadata": {"mid": "/m/1"}}]})
    return 200, {}, json.dumps({"query": {"search": [{"title": "A", "snippet": "<b>x</b> y", "size": 3}]}})


def test_remote(spark):
    urls = spark.createDataFrame([("example.org",), ("example.org",), ("ftp://x",), ("http://broken.org",)], "url string")
    got = {r.requested_url: r for r in api.fetch(urls, [remote.Fetcher(fake, "http://s")]).collect()}
    assert len(got) == 3 and got["example.org"].markdown == "# Hi" and got["example.org"].language == "de"
    assert got["ftp://x"].error["code"] == "invalid_args" and got["http://broken.org"].error["code"] == "rate_limited"
    enc = remote.Encyclopedia(fake, "http://{lang}.w")
    r = api.kb_lookup(spark.createDataFrame([("ada_l", "en"), ("ada_l", "en")], "title string, lang string"), enc).collect()
    assert len(r) == 1 and r[0].title == "Ada" and r[0].aliases == ["ada l", "Ada L"]
    assert api.kb_search(spark.createDataFrame([("q", "en")], "query string, lang string"), enc).first().snippet == "x y"
    assert api.papers(spark.createDataFrame([("q",)], "query string"), remote.Literature(fake, "http://p")).first().paper_id == "1"
    e = api.entities(spark.createDataFrame([("1", "Ada")], "id string, text string"), remote.EntityProvider(fake, "http://e")).first()
    assert (e.name, e.salience, e.mid, e.mentions) == ("Ada", 0.6124, "/m/1", 1)
    reg = remote.Registry("thing")
    reg.register("A", lambda: 1)
    assert reg.open("a") == 1 and reg.names() == ["a"]
    with pytest.raises(ValueError):
        reg.register("a", lambda: 2)
    with pytest.raises(TextError):
        reg.open("b")
    assert retry_after("7") == 7 and retry_after("x") is None and from_status(503).retriable and from_status(404).exit_code == 4
    assert json.loads(from_status(429, {"retry-after": "9"}).line())["error"]["retry_after_sec"] == 9


def test_cache_and_records(spark):
    cache = spark.sql("select 'a' key, timestamp'2020-01-01 00:00:00' cached_at, 60 ttl_seconds, 'p' payload union all select 'b', timestamp'2020-01-01 00:00:00', 600, 'q'")
    now = F.to_timestamp(F.lit("2020-01-01 00:02:00"))
    hits, misses = entities.split_cached(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), cache, now)
    assert [r.payload for r in hits.collect()] == ["q"] and sorted(r.key for r in misses.collect()) == ["a", "c"]
    r = spark.createDataFrame([(1, '{"items":[{"x":1},{"x":2}]}'), (2, '{"x":3}'), (3, "[]"), (4, None)], "id int, j string")
    assert sorted((x.id, x.record) for x in entities.records(r, "j", "items").collect()) == [(1, '{"x":1}'), (1, '{"x":2}'), (2, '{"x":3}')]


def test_facade(spark):
    df = spark.createDataFrame([("1", "# T\n\n" + EN), ("2", DE)], "id string, text string")
    assert api.readability(df, stats=True).where("id = '1'").count() == 7
    assert api.lint(df, severity="warn").count() >= 2
    m, s = api.diff(df, df)
    assert m.where("delta <> 0").count() == 0 and s.count() == 2
    assert api.metrics(spark).count() == 12


def test_listing(spark):
    df = spark.createDataFrame([("b", 1), (" a ", 2), ("b", 3), ("", 4)], "u string, n int")
    assert [r.u for r in inputs.listing(df, "u", "n").collect()] == ["b", "a"]
