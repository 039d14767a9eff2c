"""Column expressions that stay in the JVM: tokens, syllables, rounding, keys, addresses, offsets, cells.

Patterns are written without look-around where SQL needs them too. Null in, null out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.pytext import _SPACE, FOLDS, SYLLABLES_EN, TOKEN
from quillspark.functions.strip import SNIFFED_TAGS

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Col) -> Column:
    """Word tokens: letters and digits, inner apostrophes and hyphens, points and commas between digits."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Col) -> Column:
    return F.size(tokens(text))


def characters(word: Col) -> Column:
    """Letters and digits of a token."""
    return F.length(F.regexp_replace(_c(word), r"[^\p{L}\p{Nd}]", ""))


def fold(word: Col) -> Column:
    """Lower-case ASCII letters of a token; accents go to their base, other letters to x, the rest out."""
    a, b = "".join(cs for _, cs in FOLDS), "".join(base * len(cs) for base, cs in FOLDS)
    x = F.translate(F.lower(_c(word)), a, b)
    return F.regexp_replace(F.regexp_replace(x, r"[^\p{L}]", ""), "[^a-z]", "x")


def _groups(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def syllables_en(word: Col) -> Column:
    """Syllables of an English word; a number has one."""
    s = fold(word)
    v = F.regexp_replace(s, "^y", "x")
    n = _groups(v, "[aeiouy]+")
    hiatus = (F.length(s) >= 4) & (n >= 2) & v.rlike("[^aeiouy](ea|ia|io)$")
    silent = (F.length(s) >= 3) & (
        (v.rlike("[^aeiouy]e$") & ~v.rlike("[^aeiouy]le$"))
        | (v.rlike("[^aeiouy]es$") & ~v.rlike("[^aeiouy]les$|[sxzcgj]es$|[cs]hes$"))
        | (v.rlike("[^aeiouytd]ed$") & ~v.rlike("[^aeiouy]led$"))
    )
    known = F.create_map(*(F.lit(x) for kv in SYLLABLES_EN.items() for x in kv))
    counted = F.greatest(F.lit(1), n + hiatus.cast("int") - silent.cast("int"))
    return F.when(s == "", 1).otherwise(F.coalesce(known[s], counted))


def syllables_de(word: Col) -> Column:
    s = fold(word)
    nuclei = F.regexp_extract_all(F.replace(s, F.lit("qu"), F.lit("q")), F.lit("a[uiya]|e[uiye]|ie|oo|[aeiouy]"), F.lit(0))
    split = (F.length(s) >= 6) & s.endswith("ien") & (F.element_at(F.concat(F.array(F.lit("")), nuclei), -1) == "ie")
    return F.greatest(F.lit(1), F.size(nuclei) + split.cast("int"))


def rounded(x: Col, places: int) -> Column:
    """Half away from zero on the binary value, never through decimal text."""
    p = float(10**places)
    x = _c(x) * p
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)) / p


def sentiment_label(score: Col, magnitude: Col) -> Column:
    return F.when(_c(score) >= 0.25, "positive").when(_c(score) <= -0.25, "negative").when(_c(magnitude) >= 1, "mixed").otherwise("neutral")


def entity_score(salience: Col, probability: Col) -> Column:
    return F.when(_c(salience) > 0, _c(salience)).otherwise(_c(probability))


def merge_key(name: Col, kind: Col) -> Column:
    """Entities with equal keys are one: lower-cased, collapsed name and upper-cased type."""
    return F.concat_ws("\u0001", F.lower(F.trim(F.regexp_replace(_c(name), r"\s+", " "))), F.upper(_c(kind)))


def canonical_title(title: Col) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(title), "_", " "), r"\s+", " "))


def article_language(tag: Col) -> Column:
    """Base language of a tag; empty, auto and what is no tag become en."""
    low = F.lower(F.trim(_c(tag)))
    base = F.regexp_replace(low, "(?s)(?<=.)[-_].*", "")
    return F.when(base.rlike(r"\A[a-z0-9]+\z") & (base != "auto"), base).otherwise(F.lit("en"))


def _host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def article_url_title(url: Col) -> Column:
    """Canonical title in an encyclopedia address: its last path segment, unescaped; null for other addresses."""
    u = F.trim(_c(url))
    segment = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/[^?#]*)?/([^/?#]*)", 1)
    title = canonical_title(F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment))
    return F.when(_host(u).endswith("wikipedia.org") & (title != ""), title)


def article_url_language(url: Col) -> Column:
    host = _host(_c(url))
    first = F.split(host, "\\.")[0]
    named = (F.size(F.split(host, "\\.")) > 2) & ~first.isin("www", "m", "wikipedia")
    return F.when(article_url_title(url).isNotNull(), F.when(named, article_language(first)).otherwise(F.lit("en")))


def with_scheme(url: Col) -> Column:
    """https:// before an address without a scheme."""
    u = F.trim(_c(url))
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def paper_namespace(identifier: Col) -> Column:
    return F.lower(F.trim(F.regexp_extract(_c(identifier), r"^\s*([^:]+):(.+)$", 1)))


def paper_key(identifier: Col) -> Column:
    return F.trim(F.regexp_extract(_c(identifier), r"^\s*([^:]+):(.+)$", 2))


def paper_url(identifier: Col) -> Column:
    """Landing page of an identifier; null for namespaces without one."""
    ns, key = paper_namespace(identifier), paper_key(identifier)
    return (
        F.when(ns == "doi", F.concat(F.lit("https://doi.org/"), key))
        .when(ns == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), key))
        .when(ns == "pmcid", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), key, F.lit("/")))
        .when(ns == "pmid", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), key, F.lit("/")))
    )


def preferred_id(ids: Col) -> Column:
    """First identifier of a map of namespaces, doi before arxiv before pmcid before pmid."""
    one = [F.when(F.size(_c(ids)[n]) > 0, F.concat(F.lit(n + ":"), _c(ids)[n][0])) for n in ("doi", "arxiv", "pmcid", "pmid")]
    return F.coalesce(*one)


def tool_id(identifier: Col) -> Column:
    """provider/capability in lower case, of at most 200 characters each; null if malformed."""
    x = F.lower(F.trim(_c(identifier)))
    return F.when(x.rlike(r"^[a-z0-9][a-z0-9._-]{0,199}/[a-z0-9][a-z0-9/._-]{0,199}$"), x)


def sniffed(text: Col) -> Column:
    """none, html or markdown, as strip.sniff says, without leaving the JVM."""
    x = _c(text)
    doc = x.rlike(r"(?i)<!doctype\s+html|</?html\b|</?body\b")
    signs = (r"\A(?:---|\+\+\+)[ \t]*\n", r"(?md)^ {0,3}(?:```|~~~)", r"(?md)^ {0,3}#{1,6}[ \t]+\S", r"(?md)^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]+\S", r"!?\[[^\]\n]*\]\([^)\n]*\)", r"(?md)^ {0,3}\[[^\]\n]+\]:[ \t]*\S", r"(?md)^ {0,3}\|.*\|[ \t]*$")
    marked = reduce(Column.__or__, (x.rlike(p) for p in signs))
    tags = F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)</?({SNIFFED_TAGS})\b[^>]*>"), F.lit(1)), F.lower)
    blank = x.isNull() | ~x.rlike(rf"[^{_SPACE}]")
    return F.when(blank, "none").when(doc, "html").when(marked, "markdown").when((F.size(tags) >= 4) | (F.size(F.array_distinct(tags)) >= 3), "html").otherwise("none")


def redacted(secret: Col) -> Column:
    """Last four characters; all hidden up to four."""
    s = _c(secret)
    return F.when(F.length(s) <= 4, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.lit("…"), F.right(s, F.lit(4))))


def shortened(text: Col, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis."""
    s = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…")))


def capped(text: Col, limit: int) -> Column:
    """At most limit UTF-8 bytes, cut back to a whole character."""
    raw = F.substring(F.encode(_c(text), "UTF-8"), 1, limit)
    cut = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[À-ß]$|[à-ï][\u0080-¿]?$|[ð-÷][\u0080-¿]{0,2}$", "")
    return F.when(F.octet_length(_c(text)) <= limit, _c(text)).otherwise(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"))


def is_truncated(text: Col, limit: int) -> Column:
    return F.octet_length(_c(text)) > limit


def line_number(text: Col, start: Col) -> Column:
    """Line of a byte offset, from 1."""
    head = F.decode(F.substring(F.encode(_c(text), "UTF-8"), F.lit(1), _c(start)), "ISO-8859-1")
    return F.length(F.regexp_replace(head, "[^\n]", "")) + 1


def excerpt(text: Col, start: Col, end: Col) -> Column:
    return F.decode(F.substring(F.encode(_c(text), "UTF-8"), _c(start) + 1, _c(end) - _c(start)), "UTF-8")


def occurrences(text: Col, find: str) -> Column:
    """Times a literal occurs, not overlapping."""
    return ((F.length(_c(text)) - F.length(F.replace(_c(text), F.lit(find)))) / len(find)).cast("int")


def cache_key(*parts: Col) -> Column:
    """SHA-256 of a command and its sorted arguments."""
    return F.sha2(F.concat_ws("\0", _c(parts[0]), F.array_sort(F.array(*map(_c, parts[1:])))), 256)


def fresh(cached_at: Col, ttl_seconds: Col, now: Col) -> Column:
    at, by = (F.unix_micros(_c(x).cast("timestamp")) for x in (cached_at, now))
    return at + _c(ttl_seconds).cast("bigint") * 1_000_000 > by


def toon_cell(value: Col) -> Column:
    """A TOON cell: quoted where a bare one would read as something else."""
    s = _c(value)
    quote = (s == "") | s.rlike("^[ \t]|[ \t]$") | s.rlike(r'[,:"\\\[\]{}\x00-\x1f]|^[-#]') | s.isin("true", "false", "null") | s.rlike(r"\A[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z")
    body = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), s)
    return F.when(s.isNull(), "null").when(quote, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(s)


def csv_cell(value: Col) -> Column:
    s = F.coalesce(_c(value), F.lit(""))
    return F.when(s.rlike(r'[",\r\n]|^\s'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
