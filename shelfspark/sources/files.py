"""File sources and sinks: JSON with defaults, key-slug pairs in four formats, sitemaps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import display
from shelfspark.operators import browse


def read_json(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """A JSON file or folder by a declared schema; the default, or no rows, where there is none. Broken lines are dropped."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    except AnalysisException:
        return default if default is not None else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Committed JSON output: readers see all of it or the last one."""
    df.write.mode("overwrite").json(path)


def pairs(texts: DataFrame, column: str = "value") -> DataFrame:
    """ppn, slug from whole files: lines with an address, lines `ppn,slug`, a JSON array or object of either."""
    address = r"/catalogus/([0-9xX]+)/([^/?#\"\s]+)"
    body = F.trim(column)
    is_json = body.rlike(r"^[\[{]")
    obj = "struct<ppn:string,slug:string,url:string>"
    listed = F.when(body.startswith("["), F.from_json(body, f"array<{obj}>")).otherwise(F.array(F.from_json(body, obj)))
    got = lambda c, i: F.nullif(F.regexp_extract(c, address, i), F.lit(""))
    objects = texts.where(is_json).select(F.explode(listed).alias("o")).where(F.col("o").isNotNull())
    named = (F.coalesce(F.col("o.ppn"), F.lit("")) != "") & (F.coalesce(F.col("o.slug"), F.lit("")) != "")
    from_json = objects.select(F.when(named, F.col("o.ppn")).otherwise(got(F.col("o.url"), 1)).alias("ppn"), F.when(named, F.col("o.slug")).otherwise(got(F.col("o.url"), 2)).alias("slug"))
    lines = texts.where(~is_json).select(F.explode(F.split(column, r"\r?\n")).alias("l")).select(F.trim("l").alias("l")).where("l <> ''")
    row = r"^([0-9xX]+)\s*,\s*(.*)$"
    plain = F.col("l").rlike(row)
    from_lines = lines.select(F.coalesce(got(F.col("l"), 1), F.when(plain, F.regexp_extract("l", row, 1))).alias("ppn"), F.coalesce(got(F.col("l"), 2), F.when(plain, F.regexp_extract("l", row, 2))).alias("slug"))
    return from_json.unionByName(from_lines).where(F.col("ppn").isNotNull())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pairs() of files."""
    return pairs(spark.read.text(path, wholetext=True))


def sitemap(works: DataFrame, slugs: DataFrame, origin: str) -> DataFrame:
    """page, xml: book sitemaps of a fixed number of addresses each, in order of id."""
    placed = browse.sitemap_pages(works).join(slugs, "work_id", "left")
    entry = display.sitemap_entry(origin, display.book_path("slug", "work_id"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
    grouped = placed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("work_id", entry.alias("x")))).alias("e"))
    return grouped.select("page", F.concat(F.lit(head), F.array_join(F.transform("e", lambda x: x["x"]), ""), F.lit(tail)).alias("xml"))


def sitemap_index(pages: DataFrame, origin: str) -> DataFrame:
    """loc of every sitemap."""
    books = pages.select(F.concat(F.lit(f"{origin}/sitemap-books-"), F.col("page"), F.lit(".xml")).alias("loc"))
    return pages.sparkSession.createDataFrame([(f"{origin}/sitemap-{k}.xml",) for k in ("static", "browse")], "loc string").unionByName(books)
