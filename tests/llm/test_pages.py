"""Main bodies and residue."""

import datetime as dt

from quillspark.llm import pagebody, residue

PAGE = """We use cookies to make this site work and to count visits.
[Accept all](#) [Reject all](#)

* Home
* News
  * Weather

Kaulork › Guides › Help

# The water level

The old mill in [Kaul](/1) follows a draft of the report, and the people are glad.

The bakery sells cookies by the pound and asks nobody for consent.

- The names of the plants
- The editor explains it.

```
x = 4
```

| a | 1.5 |
| --- | --- |

> A quotation stands here.

16 comments
Share this page
### Related articles
- [The footnotes](/a/1)
* An honest answer
The archive keeps it. … [Read more](/a/2)

© 2017 Kaulork. All rights reserved.
Tel. 0707 70737"""


def test_body():
    kinds = {x.text: x.kind for x in pagebody.read(PAGE, "www.kaulork25.example")}
    body = [t for t, k in kinds.items() if k == "body"]
    assert body == ["# The water level", "The old mill in [Kaul](/1) follows a draft of the report, and the people are glad.", "The bakery sells cookies by the pound and asks nobody for consent.", "- The names of the plants", "- The editor explains it.", "```", "x = 4", "| a | 1.5 |", "| --- | --- |", "> A quotation stands here."]
    assert pagebody.read(None) == [] and pagebody.read(" \n") == [] and pagebody.body_text(None) is None
    assert [x.kind for x in pagebody.read("Too many requests, slow down.\r\nBack to top\r\n")] == ["body", "tool"]


def test_density_prefers_prose():
    lines = {x.text: x for x in pagebody.read(PAGE, None)}
    assert lines["- The names of the plants"].density < lines["The bakery sells cookies by the pound and asks nobody for consent."].density and lines["16 comments"].density == 0


def test_density_decides_unlisted_wordings():
    prose = "The old mill follows a draft of the report, and the people of the town are glad to see it. " * 4
    page = f"Zeitraffer\n* Kombüse\n* Plauderecke\n\n# The water level\n\n{prose}\nA short name\n\n## The songs\n\nIt rains.\n- one song\n\nKlabauter Lounge\n\n```\nx = 4\n```"
    assert {x.text for x in pagebody.read(page) if x.kind == "thin"} == {"Zeitraffer", "* Kombüse", "* Plauderecke", "Klabauter Lounge"}
    assert {x.text for x in pagebody.read("- The footnotes\n- The names") if x.kind == "body"} == {"- The footnotes", "- The names"}


def frame(spark, rows):
    t = dt.datetime(2024, 1, 1)
    full = [(i, h, u, ti, m, t + dt.timedelta(hours=j)) for j, (i, h, u, ti, m) in enumerate(rows)]
    return spark.createDataFrame(full, "response_id long, host string, page_url string, title string, markdown string, ingested_at timestamp")


def test_furniture_frame(spark):
    df = frame(spark, [(1, "h", "u", None, "Home | News | Help\n\nThe old mill follows a draft."), (1, "h", "u", None, "Home | News | Help\n\nThe old mill follows a draft."), (2, "h", "u", None, None), (3, None, None, None, "")])
    assert [(r.response_id, r.line_no) for r in pagebody.furniture_lines(df).collect()] == [(1, 1)]
    assert pagebody.furniture_lines(df.limit(0)).count() == 0 and pagebody.main_bodies(df).where("body like 'The old%'").count() == 2


def test_long_notices_count_by_their_sentences():
    prose = "The old mill follows a draft of the report, and the people of the town are glad to see it."
    notice = "We use cookies to make this site work. Some cookies are set by partners. You can change your choice at any time."
    kinds = {x.text: x.kind for n in (1, 3, 60) for x in pagebody.read(f"# The mill\n\n{prose}\n\n{' '.join([notice] * n)}")}
    assert {k for t, k in kinds.items() if t.startswith("We use")} == {"tool"} and kinds[prose] == "body"
    assert [x.kind for x in pagebody.read(f"{prose}\n{notice} {prose}")] == ["body", "body"]


def test_densities_alone_decide(monkeypatch):
    assert any(x.kind not in ("body", "") for x in pagebody.read(PAGE))
    monkeypatch.setattr(pagebody, "_select", lambda lines: lines)
    assert {x.kind for x in pagebody.read(PAGE)} == {""}  # reading only measures


def test_message_wording():
    for s in ("Too many requests, slow down.", "Diese Seite gibt es nicht mehr.", "Veuillez activer JavaScript pour continuer.", "Your text goes here.", "Verify you are human to go on."):
        assert residue.message(s), s
        assert residue.message(" ".join([s] * 40)), s
    assert residue.message("Sorry, we could not find /x. It may have been moved.")
    assert not residue.message("The old mill follows a draft of the report.") and not residue.message("The old mill keeps a draft of the report. Access denied.")


def kind(md, title=None, url="https://h/a/the-water-level-12"):
    p = residue.Page(md, "h", url, title)
    return "placeholder" if not p.filled else "filler" if p.filler else "mismatched" if p.mismatched else ""


def test_residue_pages():
    for s in ("# Head\n\nlorem lorem lorem lorem lorem lorem lorem", "xxxx xxxx xxxx xxxx xxxx", "Docta maris ipsum ultro velit quidem. Docta cura porta ordo.", "Docta maris ipsum ultro velit quidem docta cura. " * 90):
        assert kind(s) == "filler", s
    for s in ("# {{ title }}\n\nThe mill follows it.", "The mill supports {first_name} in spring.", "The mill shows %%city%%.", "It keeps [INSERT date] here.", "It is <user_name> again.", "We saw __page.body__ there.", "It has [[city]] in it.", "<%= name %> is ${amount}"):
        assert kind(s) == "placeholder", s
    assert kind("The mill follows it for a while.", title="{{title}}") == "placeholder"
    for s in ("Our template fills `{{title}}` with the heading of the page and the water level.", "```\n<h1>{{title}}</h1>\n```\n\nThe water level follows a draft of it.", "# The water level\n\n- The names", "| a | b |"):
        assert kind(s) == "", s
    assert kind("Nothing to see at this address today.") == "mismatched" and kind("The water level fell at this address.") == ""


def test_residue_frame(spark):
    odd = "Nothing to see at this address today."
    rows = [(i, f"host{i}", f"https://host{i}/a/the-water-level-{i}", None, odd) for i in range(4)]
    rows += [(20 + i, f"host{i}", f"https://host{i}/a/the-mill-{i}", "The mill", f"# The mill\n\nSorry, nobody found page {w} on host{i}, try again.") for i, w in enumerate(("kaul", "brem", "tiva", "zorn"))]
    rows += [(30 + i, f"host{i}", f"https://host{i}/a/the-ferry-{i}", "The ferry", "# The ferry\n\nNobody had expected it to last.") for i in range(4)]
    rows += [(100, "www.kaul.example", "u", None, "xxxx xxxx xxxx xxxx xxxx"), (100, "www.kaul.example", "u", None, "xxxx xxxx xxxx xxxx xxxx"), (101, "x", "u", None, None), (102, "x", "u", None, " "), (103, "x", "https://x/a/the-mill-1", "The mill", "# The mill\n\nNobody had expected the mill to last.")]
    df = frame(spark, rows)
    got = {r.response_id: r.reason for r in residue.residue(df).collect()}
    assert got == {**dict.fromkeys([*range(4), *range(20, 24)], "duplicate"), 100: "filler"}
    assert residue.residue(df.limit(0)).count() == 0


def test_without_host_evidence_no_message_is_found(spark, monkeypatch):
    rows = [(i, f"host{i}", f"https://host{i}/a/the-water-level-{i}", None, "Too many requests, slow down.") for i in range(4)]
    assert residue.residue(frame(spark, rows)).count() == 4 and residue.residue(frame(spark, rows[:2])).count() == 2 and residue.residue(frame(spark, rows[:1])).count() == 0
    monkeypatch.setattr(residue, "WORDED", 5)
    assert residue.residue(frame(spark, rows)).count() == 0


def test_long_residue_is_found(spark):
    rows = [(i, f"host{i}", f"https://host{i}/a/the-water-level-{i}", None, "Nothing to see at this address today, nor will there be tomorrow. " * 80) for i in range(4)]
    assert residue.residue(frame(spark, rows)).count() == 4


def test_one_host_with_many_addresses(spark):
    names = ["mill", "ferry", "bakery", "museum", "garden", "canal", "harvest", "lamp", "tower"]
    rows = [(i, "one", f"https://one/a/{n}-{i}", None, "Nothing to see at this address today.") for i, n in enumerate(names)]
    rows += [(20 + i, "two", "https://two/a/the-mill-1", None, "A note that stands once, at one place only.") for i in range(12)]
    rows += [(40 + i, f"host{i % 2}", f"https://host{i % 2}/a/{n}-{i}", None, "Two hosts keep this remark with them.") for i, n in enumerate(names[:7])]
    assert {(r.response_id, r.reason) for r in residue.residue(frame(spark, rows)).collect()} == {(i, "duplicate") for i in range(9)}
