"""Documents from text files, lines, JSON lines and lists, with ids, side-car fields and byte caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import native
from quillspark.sources import containers, remote
from quillspark.sources.errors import TextError

CAP = 10 << 20
DOCUMENT = "id string, text string, fields map<string,string>, truncated boolean"


def _document(key: Column, text: Column, fields: Column | None = None, cap: int = CAP) -> list[Column]:
    none = F.create_map().cast("map<string,string>")
    return [key.cast("string").alias("id"), native.capped(text, cap).alias("text"), (fields if fields is not None else none).alias("fields"), native.is_truncated(text, cap).alias("truncated")]


def provenance(df: DataFrame, **fields: Column) -> DataFrame:
    """Side-car fields added where the document has none of that name."""
    new = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col("fields"), k))
    return df.withColumn("fields", F.map_concat("fields", new))


def read_text(spark: SparkSession, paths: str | list[str], cap: int = CAP) -> DataFrame:
    """One document a file; a lone file is document 0, several go by their paths."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    single = isinstance(paths, str) or len(paths) == 1
    df = raw.select(*_document(F.lit("0") if single else F.col("file"), F.col("value"), cap=cap), "file")
    return provenance(df, file=F.col("file")).drop("file")


def read_lines(spark: SparkSession, paths: str | list[str], cap: int = CAP, numbered: bool = False) -> DataFrame:
    """Each non-blank line is a document. Ids are unique and ascending; numbered makes them count on from 0 without gaps."""
    raw = spark.read.text(paths).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    if numbered:
        # a row's partition and place in it are in the id; the partitions' sizes (one row each) give the offsets
        raw = raw.withColumn("_i", F.monotonically_increasing_id())
        part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND((1 << 33) - 1)
        sizes = raw.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
        raw = raw.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("n", F.col("_o") + place)
        return raw.select(*_document(F.col("n"), F.col("value"), cap=cap))
    return raw.select(*_document(F.monotonically_increasing_id(), F.col("value"), cap=cap))


def read_jsonl(spark: SparkSession, paths: str | list[str], text_field: str = "text", id_field: str | None = None, cap: int = CAP, strict: bool = True) -> DataFrame:
    """One document a JSON object; other fields become side-car text.

    A line that is no object, or whose text is missing or no string, is an error: strict fails the job with it, else the row
    carries an error struct and a null text.
    """
    raw = spark.read.text(paths).where(F.trim("value") != "")
    obj = F.from_json("value", "map<string,string>")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{text_field}", "variant"))
    rows = raw.withColumn("_o", obj).withColumn("_t", typed)
    problem = (
        F.when(F.col("_o").isNull() | ~F.ltrim("value").startswith("{"), "not a JSON object")
        .when(~F.map_contains_key("_o", F.lit(text_field)), f"no field {text_field}")
        .when(F.coalesce(F.col("_t"), F.lit("VOID")) != "STRING", f"field {text_field} is no string")
    )
    key = F.col("_o")[id_field] if id_field else F.monotonically_increasing_id().cast("string")
    rest = F.map_filter("_o", lambda k, v: ~k.isin(text_field, *([id_field] if id_field else [])) & v.isNotNull())
    text = F.when(problem.isNull(), F.col("_o")[text_field])
    if strict:
        text = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.substring("value", 1, 200))).cast("string")).otherwise(F.col("_o")[text_field])
    error = F.when(problem.isNotNull(), F.struct(F.lit("invalid_args").alias("code"), problem.alias("message"), F.lit(False).alias("retriable")))
    df = rows.withColumns({"_text": text, "_rest": F.coalesce(rest, F.create_map().cast("map<string,string>")), "_id": key, "error": error})
    return df.select(*_document(F.col("_id"), F.col("_text"), F.col("_rest"), cap), "error")


def from_args(spark: SparkSession, texts: list[str], cap: int = CAP) -> DataFrame:
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "n string, value string")
    return raw.select(*_document(F.col("n"), F.col("value"), cap=cap))


def read_urls(spark: SparkSession, urls: list[str], fetchers: list[remote.Fetcher], cap: int = CAP) -> DataFrame:
    """One document a distinct address, in order of the list; what the page says of itself becomes side-car text, a failure the row's error."""
    asked = spark.createDataFrame([(i, u.strip()) for i, u in enumerate(dict.fromkeys(urls)) if u.strip()], "n int, requested_url string")
    got = remote.fetch_pages(asked, fetchers, "requested_url").join(F.broadcast(asked), "requested_url")
    df = got.select(*_document(F.col("n"), F.col("markdown"), cap=cap), "error", "url", "title", "language")
    return provenance(df, url=F.col("url"), title=F.nullif(F.col("title"), F.lit("")), language=F.nullif(F.col("language"), F.lit(""))).drop("url", "title", "language")


def load(spark: SparkSession, files: list[str] | None = None, args: list[str] | None = None, kind: str = "text", urls: list[str] | None = None, fetchers: list[remote.Fetcher] | None = None, **options) -> DataFrame:
    """Addresses before files before arguments; kind is text, lines, jsonl or container. Addresses and files at once are an error."""
    if urls:
        if files:
            raise TextError("invalid_args", "give addresses or files, not both")
        if not fetchers:
            raise TextError("provider_unavailable", "no fetcher for addresses")
        return read_urls(spark, urls, fetchers, **options)
    if files:
        if kind == "lines":
            return read_lines(spark, files, **options)
        if kind == "jsonl":
            return read_jsonl(spark, files, **options)
        if kind == "container":
            got = containers.read_files(spark, files, **options)
            df = got.select(*_document(F.col("path"), F.col("markdown")), "format", "title", "path", "error")
            return provenance(df, file=F.col("path"), format=F.col("format"), title=F.nullif(F.col("title"), F.lit(""))).drop("path", "format", "title")
        return read_text(spark, files, **options)
    if args:
        return from_args(spark, args, **options)
    raise TextError("empty_input", "no input given")


def listing(df: DataFrame, col: str, position: str) -> DataFrame:
    """A list of titles, addresses or queries without exact repeats; the first of each is kept, in order."""
    kept = df.where(F.trim(col) != "").groupBy(F.trim(col).alias(col)).agg(F.min(position).alias(position))
    return kept.orderBy(position)


def with_side_cars(result: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Results with their documents' side-car fields; computed columns win."""
    j = result.join(documents.select(id_col, "fields"), id_col, "left")
    own = [F.lit(c) for c in result.columns]
    return j.withColumn("fields", F.map_filter("fields", lambda k, v: ~k.isin(*own)))
