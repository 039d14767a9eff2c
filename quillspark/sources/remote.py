"""Remote services behind injectable transports: pages, encyclopedia articles, literature, data tools, entity providers.

A transport is a picklable callable (method, url, body) -> (status, headers, text). Calls run where the rows are, one client a
partition; keys are de-duplicated before any call, and a failure becomes an error struct of its row. Registries map names to
providers. Answers are written to the checkpoint folder as they come (written=False leaves them lazy), so that a second
action doesn't repeat paid calls.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map
from quillspark.sources.errors import TextError, from_status

Transport = Callable[[str, str, dict | None], tuple[int, dict[str, str], str]]
ERROR = "error struct<code:string,message:string,retriable:boolean>"


class Registry:
    """Providers by case-insensitive name; a second registration of a name is an error; listing is sorted."""

    def __init__(self, kind: str):
        self.kind = kind
        self._makers: dict[str, Callable[[], Any]] = {}

    def register(self, name: str, make: Callable[[], Any]) -> None:
        key = name.strip().lower()
        if key in self._makers:
            raise ValueError(f"{self.kind} {name} is registered already")
        self._makers[key] = make

    def open(self, name: str) -> Any:
        make = self._makers.get(name.strip().lower())
        if make is None:
            raise TextError("invalid_args", f"unknown {self.kind} {name}", hint=f"known: {', '.join(self.names())}")
        return make()

    def names(self) -> list[str]:
        return sorted(self._makers)


fetchers, knowledge, research, data_sources, entity_providers = (Registry(k) for k in ("fetcher", "knowledge source", "research source", "data source", "entity provider"))


def _answers(df: DataFrame, written: bool) -> DataFrame:
    return checkpointed(df) if written else df


def canonical(title: str | None) -> str:
    """A title as articles are named: spaces for underscores, white space collapsed."""
    return " ".join((title or "").replace("_", " ").split())


def check_url(raw: str) -> str:
    """An address with a scheme, http or https only."""
    v = (raw or "").strip()
    if not v:
        raise TextError("invalid_args", "empty URL")
    v = v if "://" in v else f"https://{v}"
    u = urlsplit(v)
    if u.scheme.lower() not in ("http", "https"):
        raise TextError("invalid_args", f"unsupported URL scheme {u.scheme}")
    if not u.netloc:
        raise TextError("invalid_args", f"URL has no host: {raw}")
    return v


def call(transport: Transport, method: str, url: str, body: dict | None = None) -> Any:
    try:
        status, headers, text = transport(method, url, body)
    except OSError as e:
        raise TextError("network_unreachable", str(e), retriable=True) from None
    if status >= 400:
        raise from_status(status, {k.lower(): v for k, v in headers.items()}, text[:300])
    try:
        return json.loads(text)
    except ValueError:
        raise TextError("api_5xx", "unreadable answer", retriable=True) from None


def _guarded(fn: Callable[..., tuple], width: int) -> Callable[..., list[tuple]]:
    def rows(key, *args):  # noqa: ANN001, ANN202
        try:
            return [(key, *fn(key, *args), None)]
        except TextError as e:
            return [(key, *[None] * width, dict(zip(("code", "message", "retriable"), e.struct())))]

    return rows


@dataclass
class Fetcher:
    """Pages as Markdown from a scraping service."""

    transport: Transport
    base_url: str
    main_content: bool = True
    links: bool = False
    max_age: int | None = None
    claims: str | None = None  # pattern of addresses this fetcher takes

    def matches(self, url: str) -> bool:
        return bool(self.claims and re.search(self.claims, url))

    def fetch(self, url: str) -> tuple:
        target = check_url(url)
        body = {"url": target, "formats": ["markdown", *["links"] * self.links], "onlyMainContent": self.main_content}
        if self.max_age is not None:
            body["maxAge"] = self.max_age
        got = call(self.transport, "POST", f"{self.base_url}/v2/scrape", body)
        if not got.get("success"):
            raise TextError("provider_unavailable", f"could not scrape {target}")
        d = got.get("data") or {}
        m = d.get("metadata") or {}
        text = (d.get("markdown") or "").strip()
        if not text:
            raise TextError("empty_input", f"no text for {target}")
        one = lambda v: (v[0] if v else "") if isinstance(v, list) else v or ""
        return m.get("url") or m.get("sourceURL") or target, str(one(m.get("title"))).strip(), str(one(m.get("language"))).split("-")[0].lower(), text, d.get("links") or [], m.get("statusCode"), m.get("creditsUsed")


PAGE = "url string, title string, language string, markdown string, links array<string>, status_code int, credits int"


def fetch_pages(urls: DataFrame, fetchers_: list[Fetcher], url_col: str = "url", written: bool = True) -> DataFrame:
    """Each distinct address once, by the first fetcher that claims it, else the last one."""

    def make() -> Callable[..., list[tuple]]:
        def one(url):  # noqa: ANN001, ANN202
            f = next((f for f in fetchers_ if f.matches(url)), fetchers_[-1])
            return f.fetch(url)

        return _guarded(one, 7)

    distinct = urls.where(F.col(url_col).isNotNull()).select(F.trim(url_col).alias(url_col)).distinct()
    return _answers(flat_map(distinct, [url_col], make, f"requested_url string, {PAGE}, {ERROR}"), written)


@dataclass
class Encyclopedia:
    """Article summaries and search of a wiki with a REST interface; {lang} in the base address is the language."""

    transport: Transport
    base_url: str

    def lookup(self, title: str, lang: str) -> tuple:
        t = canonical(title)
        if not t:
            raise TextError("invalid_args", "empty article title")
        base = self.base_url.replace("{lang}", lang)
        d = call(self.transport, "GET", f"{base}/api/rest_v1/page/summary/{quote(t.replace(' ', '_'), safe='')}")
        names = d.get("titles") or {}
        found = d.get("title") or names.get("normalized") or t
        others = [x for x in dict.fromkeys(map(canonical, (t, names.get("normalized"), names.get("canonical")))) if x and x != canonical(found)]
        page = ((d.get("content_urls") or {}).get("desktop") or {}).get("page") or f"{base}/wiki/{quote(found.replace(' ', '_'), safe='')}"
        return found, (d.get("description") or "").strip(), (d.get("extract") or "").strip(), page, d.get("lang") or lang, others, d.get("type") == "disambiguation", (d.get("thumbnail") or {}).get("source")

    def search(self, query: str, lang: str, limit: int = 10) -> list[dict]:
        base = self.base_url.replace("{lang}", lang)
        d = call(self.transport, "GET", f"{base}/w/api.php?action=query&list=search&format=json&srlimit={min(50, max(1, limit))}&srsearch={quote(query)}")
        return [{"title": h.get("title", ""), "snippet": " ".join(html.unescape(re.sub(r"<[^>]*>", "", h.get("snippet", ""))).split()), "size": h.get("size")} for h in d.get("query", {}).get("search", [])]


def lookup_articles(requests: DataFrame, source: Encyclopedia, written: bool = True) -> DataFrame:
    """Articles of distinct (title, lang) requests."""

    def make() -> Callable[..., list[tuple]]:
        def rows(title, lang):  # noqa: ANN001, ANN202
            try:
                return [(title, lang, *source.lookup(title, lang), None)]
            except TextError as e:
                return [(title, lang, *[None] * 8, dict(zip(("code", "message", "retriable"), e.struct())))]

        return rows

    schema = f"requested string, requested_lang string, title string, description string, extract string, url string, lang string, aliases array<string>, disambiguation boolean, thumbnail string, {ERROR}"
    return _answers(flat_map(requests.select("title", "lang").distinct(), ["title", "lang"], make, schema), written)


def _listed(search: Callable[..., list[tuple]], keys: int, width: int) -> Callable[..., list[tuple]]:
    """Hits of a search by rank, or one row with the error."""

    def rows(*args):  # noqa: ANN002, ANN202
        try:
            return [(*args[:keys], i + 1, *hit, None) for i, hit in enumerate(search(*args))]
        except TextError as e:
            return [(*args[:keys], None, *[None] * width, dict(zip(("code", "message", "retriable"), e.struct())))]

    return rows


def search_articles(queries: DataFrame, source: Encyclopedia, limit: int = 10, written: bool = True) -> DataFrame:
    """Hits of distinct (query, lang) searches; a failed search is one row with its error."""

    def make() -> Callable[..., list[tuple]]:
        return _listed(lambda query, lang: [(h["title"], h["snippet"], h["size"]) for h in source.search(query, lang, limit)], 2, 3)

    return _answers(flat_map(queries.select("query", "lang").distinct(), ["query", "lang"], make, f"query string, lang string, rank int, title string, snippet string, size int, {ERROR}"), written)


RELATIONS = ("similar", "citers", "references")


@dataclass
class Literature:
    """Papers of a literature service."""

    transport: Transport
    base_url: str

    def papers(self, query: str, limit: int = 10, **filters: Any) -> list[dict]:
        body = {"query": query, "limit": min(100, max(1, limit or 10))} | {k: v for k, v in filters.items() if v}
        return call(self.transport, "POST", f"{self.base_url}/papers/search", body).get("papers", [])

    def inspect(self, paper: str) -> dict:
        found = call(self.transport, "GET", f"{self.base_url}/papers/{quote(paper, safe='')}")
        found = found.get("paper", found) if isinstance(found, dict) else {}
        if not found:
            raise TextError("not_found", f"no paper {paper}")
        return found

    def related(self, paper: str, relation: str = "similar", limit: int = 10) -> list[dict]:
        if relation not in RELATIONS:
            raise TextError("invalid_args", f"unknown relation {relation}")
        return call(self.transport, "POST", f"{self.base_url}/papers/{relation}", {"paperId": paper, "limit": min(100, max(1, limit or 10))}).get("papers", [])


PAPER = "paper_id string, primary_id string, ids map<string,array<string>>, title string, abstract string, score double, authors string, categories array<string>, created_date string, update_date string"


def _paper(p: dict) -> tuple:
    return p.get("paperId"), p.get("primaryId"), p.get("ids") or {}, p.get("title"), p.get("abstract"), float(p.get("score") or 0), p.get("authors"), p.get("categories") or [], p.get("createdDate"), p.get("updateDate")


def search_papers(queries: DataFrame, source: Literature, limit: int = 10, written: bool = True, **filters: Any) -> DataFrame:
    """Papers of distinct queries by rank; a failed search is one row with its error."""

    def make() -> Callable[..., list[tuple]]:
        return _listed(lambda query: [_paper(p) for p in source.papers(query, limit, **filters)], 1, 10)

    return _answers(flat_map(queries.select("query").distinct(), ["query"], make, f"query string, rank int, {PAPER}, {ERROR}"), written)


def related_papers(papers: DataFrame, source: Literature, relation: str = "similar", limit: int = 10, paper_col: str = "paper_id", written: bool = True) -> DataFrame:
    """Papers similar to, citing or cited by each distinct paper, by rank."""
    if relation not in RELATIONS:
        raise TextError("invalid_args", f"unknown relation {relation}")

    def make() -> Callable[..., list[tuple]]:
        return _listed(lambda paper: [_paper(p) for p in source.related(paper, relation, limit)], 1, 10)

    asked = papers.where(F.col(paper_col).isNotNull()).select(F.col(paper_col).alias("of_paper")).distinct()
    return _answers(flat_map(asked, ["of_paper"], make, f"of_paper string, rank int, {PAPER}, {ERROR}"), written)


def inspect_papers(papers: DataFrame, source: Literature, paper_col: str = "paper_id", written: bool = True) -> DataFrame:
    """The record of each distinct paper, or its error."""

    def make() -> Callable[..., list[tuple]]:
        return _guarded(lambda paper: _paper(source.inspect(paper)), 10)

    asked = papers.where(F.col(paper_col).isNotNull()).select(F.col(paper_col).alias("requested")).distinct()
    return _answers(flat_map(asked, ["requested"], make, f"requested string, {PAPER}, {ERROR}"), written)


def filter_papers(papers: DataFrame, authors: list[str] | None = None, categories: list[str] | None = None, since: str | None = None, until: str | None = None, n: int = 0) -> DataFrame:
    """The same search over a table of papers: any author, any category, dates inclusive; by score."""
    out = papers
    if authors:
        test = F.lit(False)
        for a in authors:
            test = test | F.contains(F.lower("authors"), F.lit(a.lower()))
        out = out.where(test)
    if categories:
        out = out.where(F.arrays_overlap(F.transform("categories", F.lower), F.array(*(F.lit(c.lower()) for c in categories))))
    out = out.where(F.substring("created_date", 1, 10) >= since) if since else out
    out = out.where(F.substring("created_date", 1, 10) <= until) if until else out
    return out.orderBy(F.col("score").desc_nulls_last(), "paper_id").limit(min(100, n)) if n > 0 else out


#: Shape of a tool id (fixed values).
_PROVIDER, _CAPABILITY = re.compile(r"[a-z0-9][a-z0-9._-]{0,199}"), re.compile(r"[a-z0-9][a-z0-9/._-]{0,199}")


@dataclass
class DataTools:
    """Tools of a data service: its catalogue, and runs whose raw answers entities.records splits."""

    transport: Transport
    base_url: str

    def find(self, query: str, limit: int = 10) -> list[dict]:
        return call(self.transport, "POST", f"{self.base_url}/tools/search", {"query": query, "limit": min(100, max(1, limit or 10))}).get("tools", [])

    def run(self, tool: str, options: dict) -> str:
        provider, _, capability = tool.strip().lower().partition("/")
        if not _PROVIDER.fullmatch(provider) or not _CAPABILITY.fullmatch(capability):
            raise TextError("invalid_args", f"tool id {tool} is not provider/capability")
        got = call(self.transport, "POST", f"{self.base_url}/tools/{provider}/{capability}", options)
        if got in (None, {}, []):
            raise TextError("not_found", f"{tool} found nothing")
        return json.dumps(got)


def find_tools(queries: DataFrame, source: DataTools, limit: int = 10, written: bool = True) -> DataFrame:
    """The catalogue's tools for each distinct query, by rank."""

    def one(t: dict) -> tuple:
        return t.get("id"), t.get("provider"), t.get("capability"), t.get("name"), t.get("description"), t.get("requiresOneOf") or [], json.dumps(t.get("options") or []), (t.get("response") or {}).get("about"), (t.get("response") or {}).get("key")

    def make() -> Callable[..., list[tuple]]:
        return _listed(lambda query: [one(t) for t in source.find(query, limit)], 1, 9)

    tool = "tool_id string, provider string, capability string, name string, description string, requires_one_of array<array<string>>, options string, response_about string, response_key string"
    return _answers(flat_map(queries.select("query").distinct(), ["query"], make, f"query string, rank int, {tool}, {ERROR}"), written)


def run_tool(calls: DataFrame, source: DataTools, tool: str, written: bool = True) -> DataFrame:
    """The answer for each distinct JSON of options in column options."""

    def make() -> Callable[..., list[tuple]]:
        return _guarded(lambda options: (source.run(tool, json.loads(options)),), 1)

    return _answers(flat_map(calls.select("options").distinct(), ["options"], make, f"options string, response string, {ERROR}"), written)


def parse_option(text: str) -> tuple[str, Any]:
    """key=value, the value as JSON where it parses."""
    key, eq, value = text.partition("=")
    if not eq or not key.strip():
        raise TextError("invalid_args", f"{text} is not key=value")
    try:
        return key.strip(), json.loads(value)
    except ValueError:
        return key.strip(), value


@dataclass
class EntityProvider:
    """A provider whose answers entities.parse_response reads; capabilities: entities, sentiment, categories."""

    transport: Transport
    base_url: str
    capabilities: tuple[str, ...] = ("entities",)
    languages: tuple[str, ...] = field(default_factory=tuple)

    def ask(self, what: str, text: str, lang: str | None) -> str:
        if what not in self.capabilities:
            raise TextError("provider_unavailable", f"this provider has no {what}")
        body = {"document": {"type": "PLAIN_TEXT", "content": text, **({"language": lang} if lang and lang != "auto" else {})}, "encodingType": "UTF8"}
        return json.dumps(call(self.transport, "POST", f"{self.base_url}/{what}", body))


def ask_provider(df: DataFrame, provider: EntityProvider, what: str = "entities", id_col: str = "doc_id", text_col: str = "text", lang: str | None = None, written: bool = True) -> DataFrame:
    """The provider's answer for each document as JSON, or an error; equal texts are asked about once."""

    def make() -> Callable[..., list[tuple]]:
        return _guarded(lambda text: (provider.ask(what, text or "", lang),), 1)

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    answers = _answers(flat_map(texts.distinct(), ["_text"], make, f"_text string, response string, {ERROR}"), written)
    keyed = df.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return keyed.join(answers.withColumn("_h", F.xxhash64("_text")), ["_h", "_text"], "left").select(id_col, "response", "error")
