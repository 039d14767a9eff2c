"""Entities, sentiment and categories after a provider's answer: filters, order, aggregation, enrichment.

A row holds one entity of one document: doc, pos (input order), name, type, salience, probability, mention_count,
mentions, metadata. Null scores count as 0; ties are broken by name, so results are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import native
from quillspark.functions.native import rounded

ORDERS = ("salience", "mentions", "name")


def mention_total(count: Column, mentions: Column | None = None) -> Column:
    """Mentions of an entity: the greater of its count and its list, one at least."""
    n = F.coalesce(count, F.lit(0))
    listed = F.coalesce(F.size(mentions), F.lit(0)) if mentions is not None else F.lit(0)
    return F.greatest(F.lit(1), n, listed)


def with_links(df: DataFrame) -> DataFrame:
    """wikipedia_url and mid lifted from the metadata."""
    return df.withColumns({k: F.try_element_at("metadata", F.lit(k)) for k in ("wikipedia_url", "mid")})


def filter_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    return df.where(F.upper("type").isin(*(t.strip().upper() for t in types))) if types else df


def filter_score(df: DataFrame, least: float) -> DataFrame:
    score = native.entity_score(F.coalesce("salience", F.lit(0.0)), F.coalesce("probability", F.lit(0.0)))
    return df.where(score >= least) if least > 0 else df


def order(by: str, salience: str = "salience", mentions: str = "mentions") -> list[Column]:
    if by not in ORDERS:
        raise ValueError(f"unknown order {by}")
    chain = [F.col(salience).desc(), F.col(mentions).desc(), F.col("name").asc(), F.col("type").asc()]
    return {"salience": chain, "mentions": [chain[1], chain[0], *chain[2:]], "name": [F.col("name").asc(), F.col("type").asc()]}[by]


def top(df: DataFrame, n: int, by: str = "salience", within: str | None = "doc", salience: str = "salience", mentions: str = "mentions") -> DataFrame:
    """The first n rows per document, or overall where within is None; all of them for n <= 0.

    The rank filter becomes a group limit before the shuffle, so a document with very many rows sends n a task.
    """
    if n <= 0:
        return df
    keys = order(by, salience, mentions)
    if within is None:
        return df.orderBy(*keys).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(within).orderBy(*keys))).where(F.col("_n") <= n).drop("_n")


def pipeline(df: DataFrame, types: list[str] | None = None, least: float = 0.0, by: str = "salience", n: int = 0) -> DataFrame:
    """Types, then score, then order and top of each document."""
    return top(filter_score(filter_types(df, types), least), n, by)


def aggregate(df: DataFrame) -> DataFrame:
    """Entities of the whole run by merge key: combined and average salience, mentions, documents, first links.

    Partial sums are taken before the shuffle; a hot key moves one partial row a task.
    """
    key = native.merge_key("name", "type")
    rows = df.select(
        key.alias("_key"), F.struct("doc", "pos").alias("_at"), "doc", "name", "type", F.coalesce("salience", F.lit(0.0)).alias("salience"), "mentions",
        *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("wikipedia_url", "mid") if c in df.columns),
    )
    # one row a document first: documents are then counted without a distinct
    links = [c for c in ("wikipedia_url", "mid") if c in df.columns]
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at")))
    one = rows.groupBy("_key", "doc").agg(
        F.sum("salience").alias("salience"), F.sum("mentions").alias("mentions"), F.min_by("name", "_at").alias("name"), F.min_by("type", "_at").alias("type"),
        *(first(c).alias(c) for c in links), F.min("_at").alias("_at"),
    )
    got = one.groupBy("_key").agg(
        F.min_by("name", "_at").alias("name"), F.min_by(F.upper("type"), "_at").alias("type"), F.sum("salience").alias("_sum"),
        F.sum("mentions").alias("mentions"), F.count("*").alias("documents"), *(first(c).alias(c) for c in links),
    )
    return got.select("name", "type", rounded("_sum", 4).alias("salience"), rounded(F.col("_sum") / F.col("documents"), 4).alias("avg_salience"), "mentions", "documents", *links)


def enrich(entities: DataFrame, articles: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Articles left-joined on language and canonical title from the entity's address; each key is looked up once.

    The reference data is broadcast only when its texts have at most limit bytes; beyond that the join is by keys.
    """
    keyed = entities.withColumns({"_lang": native.article_url_language("wikipedia_url"), "_title": native.article_url_title("wikipedia_url")})
    base = articles.select(native.article_language("lang").alias("_lang"), native.canonical_title("title").alias("_title"), F.struct(*articles.columns).alias("article"))
    base = base.groupBy("_lang", "_title").agg(F.min("article").alias("article"))
    size = base.agg(F.coalesce(F.sum(F.octet_length(F.to_json("article")) + 64), F.lit(0))).first()[0]
    if size <= limit:
        return keyed.join(F.broadcast(base), ["_lang", "_title"], "left").drop("_lang", "_title")
    # rows without an address match nothing: kept out of the shuffle, where they would all meet in one partition
    found = keyed.where("_title is not null").join(base, ["_lang", "_title"], "left").drop("_lang", "_title")
    return found.unionByName(keyed.where("_title is null").drop("_lang", "_title"), allowMissingColumns=True)


def put_cached(cache: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The cache with new entries (key, payload, ttl_seconds) put at now: the last put of a key stands, entries past their time are left out."""
    live = cache.where(native.fresh("cached_at", "ttl_seconds", now)).select("key", "payload", "cached_at", "ttl_seconds", F.lit(0).alias("_new"))
    put = entries.where("key is not null and payload is not null and ttl_seconds > 0").select("key", "payload", now.cast("timestamp").alias("cached_at"), "ttl_seconds", F.lit(1).alias("_new"))
    last = live.unionByName(put).groupBy("key").agg(F.max_by(F.struct("payload", "cached_at", "ttl_seconds"), F.struct("cached_at", "_new", "payload")).alias("_e"))
    return last.select("key", "_e.*")


def split_cached(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits with payload, misses) of requests with a key against entries key, cached_at, ttl_seconds, payload."""
    live = cache.where(native.fresh("cached_at", "ttl_seconds", now))
    live = live.groupBy("key").agg(F.max_by("payload", "cached_at").alias("payload"), F.max("cached_at").alias("cached_at"))
    return requests.join(live, "key"), requests.join(live, "key", "left_anti")


def cache_accounting(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    live = cache.where(native.fresh("cached_at", "ttl_seconds", now)).groupBy("key").agg(F.max("cached_at").alias("cached_at"))
    j = requests.join(live, "key", "left")
    return j.agg(F.count_if(F.col("cached_at").isNotNull()).alias("hits"), F.count_if(F.col("cached_at").isNull()).alias("misses"), F.min("cached_at").alias("oldest"))


def label_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumn("label", native.sentiment_label("score", "magnitude"))


def categories(df: DataFrame, least: float = 0.0, n: int = 0, within: str = "doc") -> DataFrame:
    """Categories at or over a confidence, by confidence and name, the first n of each document; path split at /."""
    keys = [F.col("confidence").desc(), F.col("name").asc()]
    kept = df.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*keys)))
    kept = kept.where(F.col("rank") <= n) if n > 0 else kept
    return kept.withColumn("path", F.filter(F.split("name", "/"), lambda x: x != ""))


def classifiable(df: DataFrame, text_col: str = "text", least: int = 20) -> DataFrame:
    return df.where(native.word_count(text_col) >= least)


ENTITY_JSON = "entities array<struct<name:string,type:string,salience:double,mentions:array<struct<text:struct<content:string,beginOffset:int>,type:string,probability:double>>,metadata:map<string,string>>>, languageCode string"


def parse_response(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Entity rows of a provider's JSON answers."""
    e = df.withColumn("_r", F.from_json(json_col, ENTITY_JSON)).select(*df.columns, F.col("_r.languageCode").alias("language"), F.posexplode("_r.entities").alias("pos", "_e"))
    mentions = F.transform("_e.mentions", lambda m: F.struct(m["text"]["content"].alias("text"), m["type"].alias("type"), m["text"]["beginOffset"].alias("begin_offset"), m["probability"].alias("probability")))
    best = F.array_max(F.transform("_e.mentions", lambda m: m["probability"]))
    rows = e.select(*(c for c in df.columns if c != json_col), "language", "pos", "_e.name", "_e.type", rounded("_e.salience", 4).alias("salience"),
                    F.coalesce(best, F.lit(0.0)).alias("probability"), F.size("_e.mentions").alias("mention_count"), mentions.alias("mention_list"), "_e.metadata")
    return with_links(rows).withColumn("mentions", mention_total(F.col("mention_count"), F.col("mention_list")))


SENTIMENT_JSON = "documentSentiment struct<score:double,magnitude:double>, languageCode string, language string, sentences array<struct<text:struct<content:string,beginOffset:int>,sentiment:struct<score:double,magnitude:double>>>"
CLASSIFY_JSON = "categories array<struct<name:string,confidence:double>>"


def parse_sentiment(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Score, magnitude and label of a provider's JSON answers, with their sentences; what an answer lacks is 0."""
    r = df.withColumn("_r", F.from_json(json_col, SENTIMENT_JSON))
    zero = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 4)
    each = F.transform(F.coalesce("_r.sentences", F.array()), lambda x: F.struct(
        F.coalesce(x["text"]["content"], F.lit("")).alias("text"), zero(x["sentiment"]["score"]).alias("score"), zero(x["sentiment"]["magnitude"]).alias("magnitude"),
        F.coalesce(x["text"]["beginOffset"], F.lit(0)).alias("begin_offset")))
    rows = r.select(*(c for c in df.columns if c != json_col), F.coalesce("_r.languageCode", "_r.language").alias("language"), zero(F.col("_r.documentSentiment.score")).alias("score"), zero(F.col("_r.documentSentiment.magnitude")).alias("magnitude"), each.alias("sentences"))
    return label_sentiment(rows)


def parse_categories(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Category rows of a provider's JSON answers; categories() ranks them."""
    r = df.select(*(c for c in df.columns if c != json_col), F.explode(F.from_json(json_col, CLASSIFY_JSON)["categories"]).alias("_c"))
    return r.where("_c is not null").select(*(c for c in r.columns if c != "_c"), "_c.name", rounded(F.coalesce("_c.confidence", F.lit(0.0)), 4).alias("confidence"))


def records(df: DataFrame, json_col: str, member: str | None) -> DataFrame:
    """One row a record: the members of the named list if it is one, else the answer itself."""
    whole = F.array(F.col(json_col))
    if member:
        listed = F.from_json(F.get_json_object(json_col, f"$.{member}"), "array<string>")
        is_list = F.get_json_object(json_col, f"$.{member}").startswith("[")
        whole = F.when(is_list & listed.isNotNull(), listed).otherwise(whole)
    blank = F.trim(json_col).isin("", "null", "{}", "[]") | F.col(json_col).isNull()
    return df.where(~blank).select("*", F.explode(whole).alias("record"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
