"""Collaborative documents from their JSON: tabs, blocks, lists and tables as Markdown or plain text; comments; edit checks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.native import occurrences
from quillspark.operators.rows import flat_map

#: Paragraph styles and ordered list glyphs (fixed values).
HEADINGS = {"TITLE": "# ", "SUBTITLE": "## ", **{f"HEADING_{i}": "#" * i + " " for i in range(1, 7)}}
ORDERED = frozenset(("DECIMAL", "ZERO_DECIMAL", "UPPER_ALPHA", "ALPHA", "UPPER_ROMAN", "ROMAN"))


def tabs(doc: dict) -> Iterator[tuple[str, str, list, dict]]:
    """(id, title, content, lists) depth first; a document without tabs is one tab."""

    def walk(items: list) -> Iterator[tuple[str, str, list, dict]]:
        for t in items or []:
            p, d = t.get("tabProperties", {}), t.get("documentTab", {})
            yield p.get("tabId", ""), p.get("title", ""), d.get("body", {}).get("content", []), d.get("lists", {})
            yield from walk(t.get("childTabs", []))

    if doc.get("tabs"):
        yield from walk(doc["tabs"])
    else:
        yield "", "", doc.get("body", {}).get("content", []), doc.get("lists", {})


def _run(run: dict, markdown: bool) -> str:
    s, style = run.get("content", ""), run.get("textStyle") or {}
    core = s.rstrip("\n\v")
    word = core.strip(" \t")
    if not markdown or not word.strip():
        return s
    at = core.index(word)
    new = f"**{word}**" if style.get("bold") else word
    new = f"*{new}*" if style.get("italic") else new
    url = (style.get("link") or {}).get("url")
    return core[:at] + (f"[{new}]({url})" if url else new) + core[at + len(word):] + s[len(core):]


def _element(e: dict, markdown: bool) -> str:
    if "textRun" in e:
        return _run(e["textRun"], markdown)
    if "person" in e:
        p = e["person"].get("personProperties", {})
        return p.get("name") or p.get("email", "")
    if "richLink" in e:
        p = e["richLink"].get("richLinkProperties", {})
        return f"[{p['title']}]({p['uri']})" if markdown and p.get("uri") and p.get("title") else p.get("title", "")
    return ""


def _paragraph(p: dict, lists: dict, markdown: bool) -> str:
    s = "".join(_element(e, markdown) for e in p.get("elements", []))
    if not markdown:
        return s
    s = s.replace("\v", "\n").rstrip("\n")
    if not s.strip():
        return "---" if any("horizontalRule" in e for e in p.get("elements", [])) else ""
    if "bullet" in p:
        level = p["bullet"].get("nestingLevel", 0)
        levels = lists.get(p["bullet"].get("listId"), {}).get("listProperties", {}).get("nestingLevels", [])
        ordered = level < len(levels) and levels[level].get("glyphType") in ORDERED
        return "  " * level + ("1. " if ordered else "- ") + s.lstrip(" \t")
    head = HEADINGS.get((p.get("paragraphStyle") or {}).get("namedStyleType", ""), "")
    return head + s.replace("\n", " ") if head else s


def render(content: list, lists: dict, markdown: bool = True) -> str:
    """Blocks with a blank line between them, items of a list on lines of their own; tables of contents are left out."""
    out = ""
    listed = False
    for e in content:
        if "paragraph" in e:
            s, item = _paragraph(e["paragraph"], lists, markdown), "bullet" in e["paragraph"]
        elif "table" in e:
            s, item = _table(e["table"], lists, markdown), False
        else:
            continue
        if not markdown:
            out += s
        elif s.strip():
            out += ("\n" if item and listed else "\n\n" if out else "") + s
            listed = item
    return out


def _table(t: dict, lists: dict, markdown: bool) -> str:
    rows = [[render(c.get("content", []), lists, markdown) for c in r.get("tableCells", [])] for r in t.get("tableRows", [])]
    if not markdown:
        return "".join(x for r in rows for x in r)
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(re.sub(r"\s*\n\s*", " ", x).replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def document(raw: str, tab: str | None = None, markdown: bool = True) -> tuple[str, str, str, list[dict]] | None:
    """(id, title, text, tabs) of a document's JSON; None without the tab asked for."""
    doc = json.loads(raw)
    chosen = [t for t in tabs(doc) if not tab or t[0] == tab]
    if not chosen:
        return None
    parts = []
    for _, title, content, lists in chosen:
        s = render(content, lists, markdown)
        parts.append((f"# {title}\n\n{s}".rstrip("\n") if len(chosen) > 1 and title and markdown else s))
    return doc.get("documentId", ""), doc.get("title", ""), ("\n\n" if markdown else "").join(x for x in parts if x), [{"tab_id": t[0], "title": t[1]} for t in chosen]


def read_documents(df: DataFrame, json_col: str = "response", tab: str | None = None, markdown: bool = True) -> DataFrame:
    """document_id, title, text, tabs; damaged JSON gives an error row."""

    def make() -> Callable[..., list[tuple]]:
        def rows(raw):  # noqa: ANN001, ANN202
            try:
                got = document(raw or "null", tab, markdown)
            except (ValueError, AttributeError, TypeError):
                return [(None, None, None, None, "unreadable document")]
            return [(*got, None)] if got else [(None, None, None, None, f"no tab {tab}")]

        return rows

    return flat_map(df, [json_col], make, "document_id string, title string, text string, tabs array<struct<tab_id:string,title:string>>, error string")


COMMENTS = "comments array<struct<id:string,content:string,deleted:boolean,resolved:boolean,createdTime:string,author:struct<displayName:string>,quotedFileContent:struct<value:string>,replies:array<struct<content:string,deleted:boolean>>>>"


def comments(df: DataFrame, json_col: str = "response", resolved: bool = False, limit: int = 0) -> DataFrame:
    """Comments that aren't deleted, without resolved ones unless asked for; the first `limit` of each response."""
    c = F.filter(F.from_json(json_col, COMMENTS)["comments"], lambda x: ~F.coalesce(x["deleted"], F.lit(False)) & (F.lit(resolved) | ~F.coalesce(x["resolved"], F.lit(False))))
    c = F.slice(c, 1, limit) if limit > 0 else c
    e = df.select(*(x for x in df.columns if x != json_col), F.explode(c).alias("_c"))
    replies = F.filter("_c.replies", lambda r: ~F.coalesce(r["deleted"], F.lit(False)))
    return e.select(*(x for x in e.columns if x != "_c"), "_c.id", "_c.content", F.coalesce("_c.resolved", F.lit(False)).alias("resolved"),
                    F.col("_c.author.displayName").alias("author"), F.col("_c.quotedFileContent.value").alias("quoted"), F.transform(replies, lambda r: r["content"]).alias("replies"))


def document_id(reference: Column) -> Column:
    """Id in a document's address, or the reference itself if it is one; null for other workspace kinds and anything else."""
    r = F.trim(reference)
    other = r.rlike(r"docs\.google\.com/(?:spreadsheets|presentation|forms|drawings)")
    by_path = F.regexp_extract(r, r"docs\.google\.com/(?:a/[^/]+/)?document/(?:u/\d+/)?d/([A-Za-z0-9_-]+)", 1)
    by_query = F.regexp_extract(r, r"docs\.google\.com/.*[?&]id=([A-Za-z0-9_-]+)", 1)
    bare = r.rlike("^[A-Za-z0-9_-]{20,}$")
    return F.when(other, None).when(by_path != "", by_path).when(by_query != "", by_query).when(bare, r)


def replacement_check(df: DataFrame, text_col: str, find: str, every: bool = False) -> DataFrame:
    """How often the text to replace occurs, and whether the edit is allowed: none is not_found, several need `every`."""
    n = occurrences(text_col, find)
    return df.withColumns({"matches": n, "problem": F.when(n == 0, "not_found").when((n > 1) & F.lit(not every), "ambiguous")})
