"""Registered queries of the core operators and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import native, strip
from quillspark.functions.pytext import FOLDS, SYLLABLES_EN, TOKEN
from quillspark.operators import analyze, entities, lint, readability
from quillspark.operators.rows import spread
from quillspark.sinks import encode
from quillspark.sources import remote
from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_LATER: dict[str, Callable[[], str]] = {}


def query(fn: Callable | None = None, *, sql: str | Callable[[], str] | None = None):  # noqa: ANN201
    """Registers a query, with its SQL or a function that writes it once the whole module is read."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if callable(sql):
            _LATER[f.__name__] = sql
        elif sql:
            ORACLES[f.__name__] = sql
        return f

    return add(fn) if fn else add


_TOK = TOKEN.replace("'", "''")
_FA, _FB = "".join(c for _, c in FOLDS), "".join(b * len(c) for b, c in FOLDS)
_EN_KNOWN = " ".join(f"WHEN s = '{w}' THEN {n}" for w, n in SYLLABLES_EN.items())


#: White space, closing and opening signs, abbreviations and the words of the language vote, as the SQL states them by itself (fixed values).
_WS = r"[ \t\n\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLOSE_SQL, _OPEN_SQL = r"[\x{22}\x{27}’”“»«›)\]}*_]", r"[\x{22}\x{27}‘“„«»‹(\[{\x{2d}–—*#>•]"
_ABBREVIATED = """
mr mrs ms dr prof st jr sr vs etc inc ltd co corp dept approx fig no vol univ ave blvd rd est min max sec al ed eds cf ibid jan feb mar apr jun jul aug sep sept oct nov dec
bzw ca usw evtl inkl exkl nr abb hr fr ggf ggfs vgl bspw mio mrd jh jhd str bzgl sog tel dt engl geb gest kap bes allg urspr insb zzgl mind hrsg anm bsp tsd mtl jhrl versch entspr
"""
_VOTE_DE = """
der die das den dem des ein eine einen einem einer eines und oder aber auch noch nur schon nicht ist sind sein seine ihre haben hatte hatten werden wird wurde wurden mit von zu zum zur auf für aus bei nach über unter vor durch
gegen ohne um im beim vom als dass daß weil wenn dann sich ich du er sie es wir uns euch mich dich ihm ihn ihnen kann können muss müssen soll sollen wollen sehr mehr wie was wer wo hier dort diese dieser dieses jede jeden
alle alles heute immer wieder zwischen bis nun etwa dabei damit dazu doch nichts seit sowie viele einige zwar deshalb jedoch
"""
_VOTE_EN = """
the of and to a is it that for on are as with be at this have from or by not but what all were we when there can which do how out about many then them some would like into time has more see could people than been who now find
down did get come made may over new take only work know year most very after our just think say where through much before too right any same want also well must even because here why ask need home again off play life always
both together group often until without second later idea enough real almost above while might next open begin still should world high every near own last never start under they their there's you your his her him she its
"""


def _list(words: str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words.split()) + ")"


def _syllables_sql(source: str, prefix: str = "") -> str:
    """CTEs from words of a source to table counted, which has syllables_en and syllables_de beside its columns."""
    return f"""
f AS (SELECT *, regexp_replace(regexp_replace(translate(lower(word), '{_FA}', '{_FB}'), '[^\\p{{L}}]', '', 'g'), '[^a-z]', 'x', 'g') AS s FROM {source}),
v AS (SELECT *, regexp_replace(s, '^y', 'x') AS v, regexp_extract_all(replace(s, 'qu', 'q'), 'a[uiya]|e[uiye]|ie|oo|[aeiouy]') AS g FROM f),
n AS (SELECT *, len(regexp_extract_all(v, '[aeiouy]+')) AS n FROM v),
counted AS (SELECT *,
 (CASE WHEN s = '' THEN 1 {_EN_KNOWN} ELSE greatest(1, n
   + CASE WHEN length(s) >= 4 AND n >= 2 AND regexp_matches(v, '[^aeiouy](ea|ia|io)$') THEN 1 ELSE 0 END
   - CASE WHEN length(s) >= 3 AND ((regexp_matches(v, '[^aeiouy]e$') AND NOT regexp_matches(v, '[^aeiouy]le$'))
       OR (regexp_matches(v, '[^aeiouy]es$') AND NOT regexp_matches(v, '[^aeiouy]les$|[sxzcgj]es$|[cs]hes$'))
       OR (regexp_matches(v, '[^aeiouytd]ed$') AND NOT regexp_matches(v, '[^aeiouy]led$'))) THEN 1 ELSE 0 END) END)::INT AS syllables_en,
 greatest(1, len(g) + CASE WHEN length(s) >= 6 AND s LIKE '%ien' AND g[-1] = 'ie' THEN 1 ELSE 0 END)::INT AS syllables_de FROM n)"""


def _tokens_sql(table_: str, key: str, select: str) -> str:
    """A query over table told: the tokens of every text with language, sentence, place and syllables."""
    return f"""
WITH src AS (SELECT {key}, text FROM {table_} WHERE text IS NOT NULL),
piece AS (SELECT {key}, text, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM (SELECT {key}, text, regexp_extract_all(text, '[.!?…]+|\n{_WS}*|[^.!?…\n]+') AS pieces FROM src)),
placed AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k))::BIGINT AS e FROM piece),
around AS (SELECT {key}, piece, e, substr(text, 1, e - length(piece)) AS l, substr(text, e + 1) AS r FROM placed WHERE regexp_matches(piece, '^[.!?…\n]')),
tail AS (SELECT *, regexp_extract(l, '[\\p{{L}}\\p{{Nd}}.]*$') AS w, length(regexp_extract(r, '^{_CLOSE_SQL}*')) AS c FROM around),
follow AS (SELECT *, substr(r, c + 1) AS rest FROM tail),
cut AS (SELECT {key}, CASE WHEN piece[1] = chr(10) THEN e ELSE e + c END AS pos FROM follow WHERE CASE WHEN piece[1] = chr(10) THEN length(piece) - length(replace(piece, chr(10), '')) >= 2 ELSE
  (piece <> '.' OR CASE WHEN regexp_matches(l, '\\p{{Nd}}$') THEN regexp_matches(l, '\\p{{Nd}}{{3}}$') WHEN w = '' THEN true WHEN contains(w, '.') OR length(w) = 1 THEN false ELSE lower(w) NOT IN {_list(_ABBREVIATED)} END)
  AND (rest = '' OR regexp_matches(rest, '^{_WS}+{_OPEN_SQL}*($|[^\\p{{Ll}}])') AND NOT regexp_matches(rest, '^{_WS}+{_OPEN_SQL}*\\p{{Ll}}')) END),
cutlist AS (SELECT {key}, list_sort(list(DISTINCT pos)) AS cuts FROM cut GROUP BY {key}),
split AS (SELECT {key}, text, regexp_extract_all(text, '{_TOK}') AS t, regexp_split_to_array(text, '{_TOK}') AS gaps FROM src),
tok AS (SELECT {key}, text, unnest(t) AS word, generate_subscripts(t, 1) AS idx, gaps FROM split WHERE len(t) > 0),
tokp AS (SELECT {key}, text, word, idx, gaps[idx] AS gap, (sum(length(gaps[idx]) + length(word)) OVER (PARTITION BY {key} ORDER BY idx) - length(word))::BIGINT AS pos FROM tok),
vote AS (SELECT {key}, count(*) AS n, sum((lower(word) IN {_list(_VOTE_DE)})::INT + 2 * regexp_matches(word, '[äöüÄÖÜß]')::INT + 1.5 * (strlen(lower(word)) >= 6 AND regexp_matches(lower(word), '(ung|keit|heit|schaft|lich|isch|chen|tät|ungen|nisse)$'))::INT) AS de,
  sum((lower(word) IN {_list(_VOTE_EN)})::INT + (strlen(lower(word)) >= 5 AND regexp_matches(lower(word), '(ing|ly)$'))::INT + (contains(lower(word), 'n''t') OR regexp_matches(lower(word), '[''’]s$'))::INT) AS en,
  sum((idx > 1 AND regexp_matches(word, '^\\p{{Lu}}') AND regexp_matches(word, '\\p{{Ll}}') AND NOT regexp_matches(gap, '[.!?…\n:]'))::INT) AS caps FROM tokp WHERE idx <= 2000 GROUP BY {key}),
lang AS (SELECT {key}, CASE WHEN de + CASE WHEN n >= 5 AND de > 0 THEN 0.4 * caps ELSE 0 END > en THEN 'de' ELSE 'en' END AS language FROM vote),
{_syllables_sql("(SELECT DISTINCT word FROM tok)")},
seg AS (SELECT tokp.*, cuts, len(list_filter(coalesce(cuts, []), lambda x: x <= pos)) AS seg FROM tokp LEFT JOIN cutlist USING ({key})),
told AS (SELECT seg.*, language, syllables_en, syllables_de, dense_rank() OVER (PARTITION BY {key} ORDER BY seg) AS sent FROM seg JOIN lang USING ({key}) JOIN counted USING (word))
""" + select.replace("{ws}", _WS)


_COUNTS_SQL = """
, c AS (SELECT doc_id, any_value(language) AS language, count(DISTINCT sent) AS sentences, count(*) AS words, sum(syl) AS syllables, sum(ch) AS characters, count(*) FILTER (syl >= 3) AS polysyllabic_words,
 count(*) FILTER (syl = 1) AS monosyllabic_words, count(*) FILTER (ch > 6) AS long_words
 FROM (SELECT *, CASE WHEN language = 'de' THEN syllables_de ELSE syllables_en END AS syl, length(regexp_replace(word, '[^\\p{L}\\p{Nd}]', '', 'g')) AS ch FROM told) GROUP BY doc_id)
"""


# --- text analysis over documents -------------------------------------------------------------
@query
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return analyze.analyze(spread(table(spark, d, "documents").select("doc_id", "text")), "text", mode="auto").drop("text")


@query
def readability_scores(spark: SparkSession, d: str) -> DataFrame:
    return readability.scores(document_stats(spark, d), keep=["doc_id", "language"]).select("doc_id", "language", "metric", "score", "level", "direction", "note")


@query(sql=_tokens_sql("split_texts", "text_id", """
, s AS (SELECT text_id, text, sent, count(*)::INT AS words, min(coalesce(cuts[seg], 0)) AS a, min(coalesce(cuts[seg + 1], length(text))) AS b FROM told GROUP BY text_id, text, sent),
r AS (SELECT *, substr(text, a + 1, b - a) AS raw FROM s), q AS (SELECT *, regexp_replace(regexp_replace(raw, '^{ws}+', ''), '{ws}+$', '') AS sent_text, strlen(substr(text, 1, a)) + strlen(regexp_extract(raw, '^{ws}*')) AS st FROM r)
SELECT text_id, sent::INT AS sent, sent_text, st::BIGINT AS "start", (st + strlen(sent_text))::BIGINT AS "end", words FROM q
"""))
def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    return analyze.sentences(spread(table(spark, d, "split_texts")), "text_id")


@query(sql=_tokens_sql("split_texts", "text_id", """
SELECT text_id, sent::INT AS sent, idx::INT AS idx, word, lower(word) AS lower, length(word)::INT AS runes, (CASE WHEN language = 'de' THEN syllables_de ELSE syllables_en END)::INT AS syllables,
 strlen(substr(text, 1, pos))::BIGINT AS "start", strlen(substr(text, 1, pos + length(word)))::BIGINT AS "end" FROM told
"""))
def token_table(spark: SparkSession, d: str) -> DataFrame:
    return analyze.tokens(spread(table(spark, d, "split_texts")), "text_id")


@query(sql=_tokens_sql("documents", "doc_id", _COUNTS_SQL + """
SELECT d.doc_id, coalesce(c.language, 'en') AS language, true AS detected, coalesce(sentences, 0)::BIGINT AS sentences, coalesce(words, 0)::BIGINT AS words, coalesce(syllables, 0)::BIGINT AS syllables, coalesce(characters, 0)::BIGINT AS characters,
 coalesce(polysyllabic_words, 0)::BIGINT AS polysyllabic_words, coalesce(monosyllabic_words, 0)::BIGINT AS monosyllabic_words, coalesce(long_words, 0)::BIGINT AS long_words
FROM documents d LEFT JOIN c USING (doc_id)
"""))
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the texts as they stand, nothing stripped."""
    return analyze.analyze(spread(table(spark, d, "documents").select("doc_id", "text")), "text").drop("text", "avg_sentence_length", "avg_syllables_per_word", "avg_word_length")


@query(sql=lambda: _tokens_sql("documents", "doc_id", _COUNTS_SQL + "SELECT doc_id, metric, score, level, grade FROM (" + _metric_sql("c", "doc_id") + ")"))
def text_scores(spark: SparkSession, d: str) -> DataFrame:
    return readability.scores(text_stats(spark, d), keep=["doc_id"]).select("doc_id", "metric", "score", "level", "grade")


@query(sql=lambda: _tokens_sql("documents", "doc_id", _COUNTS_SQL + f"""
, m AS ({_metric_sql("c", "doc_id")}), j AS (SELECT doc_id, bool_or(metric IN ('flesch', 'amstad', 'lix')) AS judged, bool_or(metric IN ('flesch', 'amstad') AND score < 30 OR metric = 'lix' AND score > 60) AS failing FROM m GROUP BY doc_id)
SELECT count(*) AS documents, count(*) FILTER (judged) AS judged, count(*) FILTER (failing) AS failing, count(*) FILTER (judged) > 0 AND count(*) FILTER (failing) = 0 AS passed FROM j
"""))
def text_gate(spark: SparkSession, d: str) -> DataFrame:
    return readability.gate_verdict(text_scores(spark, d), "doc_id", under={"flesch": 30.0, "amstad": 30.0}, over={"lix": 60.0})


@query
def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint(spread(table(spark, d, "documents")))


@query
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return lint.summary(lint_findings(spark, d))


@query
def lint_warnings(spark: SparkSession, d: str) -> DataFrame:
    return lint.filter_severity(lint_findings(spark, d), "warn")


@query
def stripped_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "scrape_responses").select("response_id", "ingested_at", "markdown")).select("response_id", "ingested_at", strip.strip_column(F.col("markdown")).alias("prose"))


@query
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return readability.gate_verdict(readability_scores(spark, d), "doc_id", under={"flesch": 30.0, "amstad": 30.0}, over={"lix": 60.0})


@query(sql=f"""
SELECT doc_id, len(t)::INT AS words, list_sum(list_transform(t, lambda w: length(regexp_replace(w, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))))::BIGINT AS characters,
       len(list_filter(t, lambda w: length(regexp_replace(w, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) > 6))::INT AS long_words
FROM (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS t FROM documents) WHERE len(t) > 0
""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", native.tokens("text").alias("t")).where(F.size("t") > 0)
    return t.select(
        "doc_id", F.size("t").alias("words"), F.aggregate("t", F.lit(0).cast("bigint"), lambda a, w: a + native.characters(w)).alias("characters"),
        F.size(F.filter("t", lambda w: native.characters(w) > 6)).alias("long_words"))


@query(sql=f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(abstract, '{_TOK}')) AS word FROM papers),{_syllables_sql("w")}
SELECT word, syllables_en, syllables_de FROM counted
""")
def word_syllables(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "papers").select(F.explode(native.tokens("abstract")).alias("word")).distinct()
    return w.select("word", native.syllables_en("word").alias("syllables_en"), native.syllables_de("word").alias("syllables_de"))


@query(sql=f"""
SELECT doc_id, w AS word, length(w)::INT AS runes, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS w FROM documents)
WHERE length(w) > 20 AND regexp_matches(w, '[A-Za-z]|[^\\x00-\\x7F]') GROUP BY 1, 2, 3
""")
def long_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(native.tokens("text")).alias("word"))
    w = w.where((F.length("word") > 20) & F.col("word").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    return w.groupBy("doc_id", "word", F.length("word").alias("runes")).agg(F.count("*").alias("n"))


_SNIFF_MD = [r"\A(?:---|\+\+\+)[ \t]*\n", r"(?m)^ {0,3}(?:```|~~~)", r"(?m)^ {0,3}#{1,6}[ \t]+\S", r"(?m)^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]+\S", r"!?\[[^\]\n]*\]\([^)\n]*\)", r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]*\S", r"(?m)^ {0,3}\|.*\|[ \t]*$"]


@query(sql=f"""
SELECT article_no, retrieved_at, CASE WHEN extract_text IS NULL OR NOT regexp_matches(extract_text, '[^\\s\\x{{00a0}}]') THEN 'none'
 WHEN regexp_matches(extract_text, '(?i)<!doctype\\s+html|</?html\\b|</?body\\b') THEN 'html'
 WHEN {' OR '.join(f"regexp_matches(extract_text, '{p}')" for p in _SNIFF_MD)} THEN 'markdown'
 WHEN len(t) >= 4 OR len(list_distinct(t)) >= 3 THEN 'html' ELSE 'none' END AS kind
FROM (SELECT *, list_transform(regexp_extract_all(extract_text, '(?i)</?({strip.SNIFFED_TAGS})\\b[^>]*>', 1), lambda x: lower(x)) AS t FROM articles)
""")
def sniffed_articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_no", "retrieved_at", native.sniffed("extract_text").alias("kind"))


# --- metrics over stored statistics -----------------------------------------------------------
def _paper_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_stats").withColumn("language", F.when(native.article_language("lang_code") == "de", "de").otherwise("en"))


_LANG = "CASE WHEN regexp_replace(lower(trim(lang_code)), '^(.[^-_]*)[-_].*', '\\1') = 'de' THEN 'de' ELSE 'en' END"
_STATS = f"(SELECT *, {_LANG} AS language FROM paper_stats WHERE words > 0 AND sentences > 0)"


def _round(x: str, p: int = 1) -> str:
    f = float(10**p)
    return f"(CASE WHEN ({x}) * {f} < 0 THEN -floor(-(({x}) * {f}) + 0.5) ELSE floor(({x}) * {f} + 0.5) END / {f} + 0.0)"


_ASL, _ASW, _AWL = "words::DOUBLE / sentences::DOUBLE", "syllables::DOUBLE / words::DOUBLE", "characters::DOUBLE / words::DOUBLE"
_MS, _IW, _ES = ("100 * {}::DOUBLE / words::DOUBLE".format(c) for c in ("polysyllabic_words", "long_words", "monosyllabic_words"))
#: Bands as the SQL states them by itself (fixed values): test, level, grade.
_FLESCH_SQL = [(90, "very easy", "5th grade"), (80, "easy", "6th grade"), (70, "fairly easy", "7th grade"), (60, "standard", "8th–9th grade"), (50, "fairly difficult", "10th–12th grade"), (30, "difficult", "college"), (None, "very confusing", "college graduate")]
_AMSTAD_SQL = [(90, "sehr leicht", "4th grade"), (80, "leicht", "5th–6th grade"), (70, "mittelleicht", "7th grade"), (60, "mittel", "8th–9th grade"), (50, "mittelschwer", "10th–12th grade"), (30, "schwer", "Studium"), (None, "sehr schwer", "akademisch")]
_US_SQL = [(6, "very easy", "elementary school (up to 6th grade)"), (9, "easy", "middle school (7th–9th grade)"), (12, "medium", "high school (10th–12th grade)"), (16, "difficult", "college"), (None, "very difficult", "college graduate")]
_WSTF_SQL = [(6, "sehr leicht", "4.–6. Schulstufe"), (8, "leicht", "6.–8. Schulstufe"), (10, "mittel", "8.–10. Schulstufe"), (12, "schwer", "10.–12. Schulstufe"), (None, "sehr schwer", "Studium")]
_LIX_SQL = [(25, "very easy", "children''s literature"), (35, "easy", "fiction, popular press"), (45, "medium", "normal prose"), (55, "difficult", "technical, non-fiction"), (None, "very difficult", "academic")]


def _bands(bands: list[tuple], op: str, outside: tuple[str, str] = ("", "")) -> tuple[str, str]:
    """(level, grade) of column score."""
    return tuple("CASE " + outside[k] + " ".join(f"WHEN score {op} {b[0]} THEN '{b[1 + k]}'" if b[0] is not None else f"ELSE '{b[1 + k]}'" for b in bands) + " END" for k in (0, 1))  # type: ignore[return-value]


_EASE_EN, _EASE_DE, _US, _LIX = _bands(_FLESCH_SQL, ">="), _bands(_AMSTAD_SQL, ">="), _bands(_US_SQL, "<="), _bands(_LIX_SQL, "<")
_WSTF = _bands(_WSTF_SQL, "<=", ("WHEN score < 4 THEN 'unter der Skala' WHEN score > 15 THEN 'über der Skala' ", "WHEN score < 4 THEN 'unter der 4. Schulstufe' WHEN score > 15 THEN 'über der 12. Schulstufe' "))
_FORMULAS = {
    "flesch": ("en", f"206.835 - 1.015 * ({_ASL}) - 84.6 * ({_ASW})", _EASE_EN, "higher_is_easier"),
    "amstad": ("de", f"180 - ({_ASL}) - 58.5 * ({_ASW})", _EASE_DE, "higher_is_easier"),
    "flesch-kincaid": ("en", f"0.39 * ({_ASL}) + 11.8 * ({_ASW}) - 15.59", _US, "lower_is_easier"),
    "gunning-fog": ("en", f"0.4 * (({_ASL}) + {_MS})", _US, "lower_is_easier"),
    "smog": ("en", "1.0430 * sqrt(polysyllabic_words::DOUBLE * 30 / sentences::DOUBLE) + 3.1291", _US, "lower_is_easier"),
    "coleman-liau": ("en", f"0.0588 * (100 * ({_AWL})) - 0.296 * (100 * sentences::DOUBLE / words::DOUBLE) - 15.8", _US, "lower_is_easier"),
    "ari": ("en", f"4.71 * ({_AWL}) + 0.5 * ({_ASL}) - 21.43", _US, "lower_is_easier"),
    "wstf1": ("de", f"0.1935 * ({_MS}) + 0.1672 * ({_ASL}) + 0.1297 * ({_IW}) - 0.0327 * ({_ES}) - 0.875", _WSTF, "lower_is_easier"),
    "wstf2": ("de", f"0.2007 * ({_MS}) + 0.1682 * ({_ASL}) + 0.1373 * ({_IW}) - 2.779", _WSTF, "lower_is_easier"),
    "wstf3": ("de", f"0.2963 * ({_MS}) + 0.1905 * ({_ASL}) - 1.1144", _WSTF, "lower_is_easier"),
    "wstf4": ("de", f"0.2744 * ({_MS}) + 0.2656 * ({_ASL}) - 1.693", _WSTF, "lower_is_easier"),
    "lix": (None, f"({_ASL}) + {_IW}", _LIX, "lower_is_easier"),
}


def _metric_sql(source: str, key: str, names: list[str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, language, '{m}' AS metric, score, {level[0]} AS level, {level[1]} AS grade, '{way}' AS direction FROM (SELECT {key}, language, {_round(x)} AS score FROM {source} WHERE {f'language = {lang!r}' if lang else 'true'})"
        for m, (lang, x, level, way) in _FORMULAS.items() if not names or m in names
    )


@query(sql=_metric_sql(_STATS, "paper_id"))
def metrics_from_stats(spark: SparkSession, d: str) -> DataFrame:
    return readability.scores(_paper_stats(spark, d), keep=["paper_id", "language"]).select("paper_id", "language", "metric", "score", "level", "grade", "direction")


@query(sql=f"SELECT paper_id, metric, score FROM ({_metric_sql(_STATS, 'paper_id')}) WHERE (metric = 'flesch' AND score < 40) OR (metric = 'amstad' AND score < 40) OR (metric = 'lix' AND score > 55)")
def gated_papers(spark: SparkSession, d: str) -> DataFrame:
    s = readability.scores(_paper_stats(spark, d), keep=["paper_id"])
    return readability.gate(s, under={"fre": 40.0, "amstad": 40.0}, over={"lix": 55.0}).select("paper_id", "metric", "score")


_EASE_NAMES = ["flesch", "amstad", "flesch-kincaid"]
_RUNS = f"""(SELECT doc_id, arg_min(struct_pack(s := sentences, w := words, y := syllables, l := lang_code, r := run_at), run_at) AS b,
 arg_max(struct_pack(s := sentences, w := words, y := syllables, l := lang_code, r := run_at), run_at) AS a
 FROM readability_docs WHERE words > 0 AND sentences > 0 AND syllables IS NOT NULL GROUP BY doc_id)"""


@query(sql=f"""
WITH r AS {_RUNS},
x AS ({_metric_sql("(SELECT doc_id, b.s AS sentences, b.w AS words, b.y AS syllables, " + _LANG.replace("lang_code", "a.l") + " AS language FROM r)", "doc_id", _EASE_NAMES)}),
y AS ({_metric_sql("(SELECT doc_id, a.s AS sentences, a.w AS words, a.y AS syllables, " + _LANG.replace("lang_code", "a.l") + " AS language FROM r)", "doc_id", _EASE_NAMES)})
SELECT y.doc_id, y.metric, x.score AS before, y.score AS after, {_round("y.score - x.score")} AS delta,
 CASE WHEN y.direction = 'higher_is_easier' THEN {_round("y.score - x.score")} > 0 ELSE {_round("y.score - x.score")} < 0 END AS improved
FROM y JOIN x ON x.doc_id = y.doc_id AND x.metric = y.metric
""")
def diff_runs(spark: SparkSession, d: str) -> DataFrame:
    """First against last run of each document."""
    r = table(spark, d, "readability_docs").where("words > 0 AND sentences > 0 AND syllables IS NOT NULL")
    lang = F.when(native.article_language("lang_code") == "de", "de").otherwise("en")
    r = r.select("doc_id", "run_at", F.struct("sentences", "words", "syllables", lang.alias("language")).alias("s"))
    g = r.groupBy("doc_id").agg(F.min_by("s", "run_at").alias("b"), F.max_by("s", "run_at").alias("a"))
    return readability.diff(g.select("doc_id", "b.*"), g.select("doc_id", "a.*"), "doc_id", _EASE_NAMES)


@query(sql=f"""
SELECT CASE WHEN min({_LANG}) = max({_LANG}) THEN min({_LANG}) END AS language, bool_and(language_detected) AS detected, false AS truncated, count(*) AS documents FROM readability_docs
""")
def run_meta(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "readability_docs").withColumns({"language": F.when(native.article_language("lang_code") == "de", "de").otherwise("en"), "detected": F.col("language_detected")})
    return readability.run_meta(r)


# --- entities: orders stand for a provider's rows ---------------------------------------------------
def _entities(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a document, an order an entity of it."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit("-"), F.lit("  "))).alias("name"), F.lower("o_orderstatus").alias("type"),
        (F.col("o_totalprice") / 1e6).alias("salience"), F.lit(0.0).alias("probability"), entities.mention_total((F.col("o_orderkey") % 4).cast("bigint")).alias("mentions"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://de.wikipedia.org/wiki/Artikel_"), F.col("o_orderkey") % 50)).otherwise("").alias("wikipedia_url"))


_ENT = """(SELECT o_custkey AS doc, o_orderkey AS pos, '  ' || replace(o_orderpriority, '-', '  ') AS name, lower(o_orderstatus) AS type, o_totalprice / 1e6 AS salience,
 greatest(1, o_orderkey % 4) AS mentions, CASE WHEN o_orderkey % 3 = 0 THEN 'https://de.wikipedia.org/wiki/Artikel_' || (o_orderkey % 50) ELSE '' END AS wikipedia_url FROM orders)"""


@query(sql=f"""
SELECT doc, pos, name, type, salience FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY salience DESC, mentions DESC, name, type) AS n
 FROM {_ENT} WHERE upper(type) IN ('O', 'F') AND salience >= 0.05) WHERE n <= 3
""")
def entity_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return entities.pipeline(_entities(spark, d), ["o", "F"], 0.05, "salience", 3).select("doc", "pos", "name", "type", "salience")


@query(sql=f"""
SELECT arg_min(name, (doc, pos)) AS name, upper(type) AS type, floor(sum(salience) * 10000 + 0.5) / 10000 AS salience,
 floor(sum(salience) / count(DISTINCT doc) * 10000 + 0.5) / 10000 AS avg_salience, sum(mentions)::BIGINT AS mentions, count(DISTINCT doc) AS documents,
 arg_min(wikipedia_url, (doc, pos)) FILTER (wikipedia_url <> '') AS wikipedia_url
FROM {_ENT} GROUP BY lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), upper(type)
""")
def entity_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return entities.aggregate(_entities(spark, d))


@query(sql=f"""
SELECT e.doc, e.pos, a.article_title FROM {_ENT} e LEFT JOIN
 (SELECT 'Artikel ' || (article_no % 50) AS t, min('A ' || (article_no % 50)) AS article_title FROM articles WHERE coalesce(lang_code, '') = 'de' GROUP BY 1) a
 ON e.wikipedia_url <> '' AND a.t = replace(split_part(e.wikipedia_url, '/wiki/', 2), '_', ' ')
""")
def entity_enrich(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("article_no") % 50).cast("string")
    a = table(spark, d, "articles").where("coalesce(lang_code, '') = 'de'").select(F.concat(F.lit("Artikel_"), k).alias("title"), F.lit("de-DE").alias("lang"), F.concat(F.lit("A "), k).alias("shown"))
    return entities.enrich(_entities(spark, d), a).select("doc", "pos", F.col("article.shown").alias("article_title"))


@query(sql="SELECT event_id, CASE WHEN s >= 0.25 THEN 'positive' WHEN s <= -0.25 THEN 'negative' WHEN m >= 1 THEN 'mixed' ELSE 'neutral' END AS label FROM (SELECT event_id, (event_id % 21 - 10) / 20.0::DOUBLE AS s, (event_id % 5) / 2.0::DOUBLE AS m FROM events)")
def sentiment_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 21 - 10) / 20.0).alias("score"), ((F.col("event_id") % 5) / 2.0).alias("magnitude"))
    return entities.label_sentiment(e).select("event_id", "label")


@query(sql="""
SELECT doc, name, confidence, rank::INT AS rank, len(list_filter(string_split(name, '/'), lambda x: x <> ''))::INT AS depth FROM (
 SELECT doc, name, confidence, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, name) AS rank FROM (
  SELECT p_size AS doc, '/' || p_brand || '/' || p_type || '/' || p_partkey AS name, p_retailprice / 2000 AS confidence FROM part) WHERE confidence >= 0.1) WHERE rank <= 5
""")
def ranked_categories(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_size").alias("doc"), F.concat_ws("/", F.lit(""), "p_brand", "p_type", "p_partkey").alias("name"), (F.col("p_retailprice") / 2000).alias("confidence"))
    return entities.categories(c, 0.1, 5).select("doc", "name", "confidence", "rank", F.size("path").alias("depth"))


@query(sql=f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_TOK}')) >= 20")
def classifiable_documents(spark: SparkSession, d: str) -> DataFrame:
    return entities.classifiable(table(spark, d, "documents")).select("doc_id")


# --- keys, addresses, encoders ---------------------------------------------------------------------
@query(sql="""
SELECT paper_id, update_date, primary_id, lower(trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 1))) AS namespace,
 CASE lower(trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 1))) WHEN 'doi' THEN 'https://doi.org/' || trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 2))
  WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 2)) WHEN 'pmcid' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 2)) || '/'
  WHEN 'pmid' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || trim(regexp_extract(primary_id, '^\\s*([^:]+):(.+)$', 2)) || '/' END AS landing
FROM papers
""")
def paper_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", "update_date", "primary_id", native.paper_namespace("primary_id").alias("namespace"), native.paper_url("primary_id").alias("landing"))


@query(sql="SELECT paper_id, update_date, score FROM papers WHERE score >= 0 AND (contains(lower(authors), 'a')) AND substr(created_date, 1, 10) >= '1990'")
def filtered_papers(spark: SparkSession, d: str) -> DataFrame:
    return remote.filter_papers(table(spark, d, "papers").where("score >= 0"), authors=["A"], since="1990").select("paper_id", "update_date", "score")


@query(sql="SELECT trim(u) AS url, min(request_id) AS request_id FROM (SELECT request_id, CASE WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM scrape_requests) WHERE trim(u) <> '' GROUP BY 1")
def distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "scrape_requests").select("request_id", native.with_scheme("url").alias("url"))
    return u.where(F.trim("url") != "").groupBy(F.trim("url").alias("url")).agg(F.min("request_id").alias("request_id"))


@query(sql="SELECT doc_id, source, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79)) || '…' END AS shown FROM (SELECT doc_id, source, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM documents)")
def shortened_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", native.shortened("title", 80).alias("shown"))


@query(sql="SELECT doc_id, octet_length(encode(text)) > 1000 AS truncated FROM documents")
def byte_caps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", native.is_truncated("text", 1000).alias("truncated"))


@query(sql="SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS last_line FROM documents")
def last_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line number of each text's end."""
    return table(spark, d, "documents").select("doc_id", native.line_number("text", F.octet_length("text")).cast("bigint").alias("last_line"))


@query(sql="""
SELECT n_nationkey || ',' || CASE WHEN n_name IS NULL THEN 'null' WHEN n_name = '' OR regexp_matches(n_name, '^[ \\t]|[ \\t]$|[,:"\\\\\\[\\]{}\\x00-\\x1f]|^[-#]') THEN '"' || n_name || '"' ELSE n_name END || ',' || n_regionkey AS line FROM nation
""")
def toon_rows(spark: SparkSession, d: str) -> DataFrame:
    return encode.toon_lines(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(sql="""
SELECT coalesce(c_custkey::VARCHAR, '') || ',' || CASE WHEN regexp_matches(c_name, '[",\\r\\n]|^\\s') THEN '"' || replace(c_name, '"', '""') || '"' ELSE coalesce(c_name, '') END || ',' || coalesce(c_mktsegment, '') AS line FROM customer
""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return encode.csv_lines(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query(sql="""
WITH c AS (SELECT o_custkey % 500 AS key, max(o_orderdate) AS put FROM orders GROUP BY 1),
live AS (SELECT * FROM c WHERE put + INTERVAL 365 DAY > TIMESTAMP '1999-01-01')
SELECT count(live.key) AS hits, count(*) - count(live.key) AS misses, min(live.put) AS oldest FROM (SELECT DISTINCT event_id % 700 AS key FROM events) r LEFT JOIN live USING (key)
""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for cache entries that live a year, seen from the first day of 1999."""
    cache = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("key"), F.col("o_orderdate").alias("cached_at"), F.lit(365 * 86400).alias("ttl_seconds"), F.lit("x").alias("payload"))
    requests = table(spark, d, "events").select((F.col("event_id") % 700).alias("key")).distinct()
    return entities.cache_accounting(requests, cache, F.to_timestamp(F.lit("1999-01-01")))


@query(sql="""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2
""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The windowed count of the stream operators over the whole table."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("v"))
    return e.select(F.col("w.start").alias("start"), "event_type", "events", native.rounded("v", 2).alias("total"))


@query(sql="""
SELECT event_id, ts, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    """First of each kind a user: the batch form of the stream's de-duplication."""
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("_at"))
    return e.groupBy("user_id", "event_type").agg(F.min("_at").alias("_at")).select("_at.event_id", "_at.ts", "user_id", "event_type")


ORACLES |= {k: make() for k, make in _LATER.items()}
