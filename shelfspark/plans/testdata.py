"""A catalog made from the driver's tables: a pure projection that Spark and DuckDB compute alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.plans import catalog
from shelfspark.session import table

AUTHORS = ("Anna Vrij", "Bob de Wit", "Bob De Wit", "Buren, van", "Øyvind Strøm", "Cara Licht | Bernlef", "Élodie Noël (red.)", None)
PUBLISHERS = ("Querido, Amsterdam", "querido, [Amsterdam]", "Querido, Amsterdam", "De Correspondent", "Spanning BV", "Sol  Editorial.")

#: DuckDB's form of the editions; the CTE that every catalog oracle begins with.
EDITIONS_SQL = """docs AS (
  SELECT *, lpad(doc_id::VARCHAR, 9, '0') AS ppn, left(split_part(text, chr(10), 1), 120) AS line FROM documents
), editions AS (
  SELECT ppn, doc_id,
    line || CASE WHEN doc_id % 6 = 0 THEN ' - luisterboek' ELSE '' END AS title,
    CASE length(line) % 8 WHEN 0 THEN 'Anna Vrij' WHEN 1 THEN 'Bob de Wit' WHEN 2 THEN 'Bob De Wit' WHEN 3 THEN 'Buren, van'
      WHEN 4 THEN 'Øyvind Strøm' WHEN 5 THEN 'Cara Licht | Bernlef' WHEN 6 THEN 'Élodie Noël (red.)' END AS author,
    CASE WHEN doc_id % 3 = 0 THEN 'audiobook' ELSE 'ebook' END AS format,
    CASE WHEN doc_id % 29 = 0 THEN NULL WHEN lang = 'en' THEN 'Engels' WHEN lang = 'fr' THEN 'Frans' WHEN lang = 'de' THEN 'Duits' WHEN lang = 'es' THEN 'Spaans' END AS language,
    CASE doc_id % 7 WHEN 0 THEN 'Querido, Amsterdam' WHEN 1 THEN 'querido, [Amsterdam]' WHEN 2 THEN 'Querido, Amsterdam' WHEN 3 THEN 'De Correspondent'
      WHEN 4 THEN 'Spanning BV' WHEN 5 THEN 'Sol  Editorial.' ELSE 'Uitgeverij ' || source END AS publisher,
    (CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 1990 + doc_id % 35 END)::INTEGER AS year,
    CASE WHEN doc_id % 10 = 0 THEN 'De reeks ' || (doc_id % 40) WHEN doc_id % 5 = 0 THEN 'De Reeks ' || (doc_id % 40) END AS series,
    CASE WHEN doc_id % 5 = 0 THEN (doc_id % 9)::INTEGER END AS series_no,
    CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 2)::INTEGER END AS ereader,
    CASE WHEN doc_id % 4 = 0 THEN (doc_id % 1000)::INTEGER END AS added_rank,
    text AS summary,
    CASE WHEN doc_id % 6 = 0 THEN 'pasta, italiaans' END AS keywords,
    CASE doc_id % 3 WHEN 0 THEN 'Jeugd' WHEN 1 THEN 'Volwassenen' END AS audience,
    CASE WHEN doc_id % 50 = 0 THEN lpad((doc_id + 1)::VARCHAR, 9, '0') END AS related,
    ['Genre ' || (length(line) % 6), 'Ond' || CASE WHEN doc_id % 2 = 0 THEN 'é' ELSE 'e' END || 'rwerp ' || (length(line) % 4)] AS subjects
  FROM docs
)"""


def _choice(index, values):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v).cast("string")).otherwise(out)
    return out


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as editions; see EDITIONS_SQL."""
    d, line = F.col("doc_id"), F.col("line")
    docs = table(spark, sf_dir, "documents").withColumn("line", F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(120)))
    ppn = lambda x: F.lpad(x.cast("string"), 9, "0")
    language = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "Engels", "fr", "Frans", "de", "Duits", "es", "Spaans")]), F.col("lang"))
    series = F.concat(F.when(d % 10 == 0, "De reeks ").otherwise("De Reeks "), (d % 40).cast("string"))
    second = F.concat(F.lit("Ond"), F.when(d % 2 == 0, "é").otherwise("e"), F.lit("rwerp "), (F.length(line) % 4).cast("string"))
    return docs.select(
        ppn(d).alias("ppn"),
        "doc_id",
        F.concat(line, F.when(d % 6 == 0, " - luisterboek").otherwise("")).alias("title"),
        _choice(F.length(line) % 8, AUTHORS).alias("author"),
        F.when(d % 3 == 0, "audiobook").otherwise("ebook").alias("format"),
        F.when(d % 29 != 0, language).alias("language"),
        F.when(d % 7 < 6, _choice(d % 7, PUBLISHERS)).otherwise(F.concat(F.lit("Uitgeverij "), "source")).alias("publisher"),
        F.when(d % 31 == 0, 0).otherwise(1990 + d % 35).cast("int").alias("year"),
        F.when(d % 5 == 0, series).alias("series"),
        F.when(d % 5 == 0, d % 9).cast("int").alias("series_no"),
        F.when(d % 3 != 0, d % 2).cast("int").alias("ereader"),
        F.when(d % 4 == 0, d % 1000).cast("int").alias("added_rank"),
        F.col("text").alias("summary"),
        F.when(d % 6 == 0, "pasta, italiaans").alias("keywords"),
        _choice(d % 3, ("Jeugd", "Volwassenen")).alias("audience"),
        F.when(d % 50 == 0, F.array(ppn(d + 1))).alias("related_ppns"),
        F.array(F.concat(F.lit("Genre "), (F.length(line) % 6).cast("string")), second).alias("subjects"),
    )


_SNAPSHOTS: dict[tuple[str, str], str] = {}


def snapshot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The published catalog of documents: built and written once a session, read by every page and report.

    works_fts is in pieces here: documents give works of thousands of whole texts.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPSHOTS:
        folder = workspace.new_path(spark, "catalog")
        with workspace.scope(spark):  # what the published tables are made from goes
            built = catalog.build(editions(spark, sf_dir))
            # Later tables are derived from the written editions, so the grouping runs once.
            first = workspace.materialize(built["editions"], "editions")
            tables = catalog.derive(first)
            catalog.publish(tables | {"works_fts": catalog.text_pieces(first, tables["work_genres"])}, folder, "v1")
        _SNAPSHOTS[key] = folder
    return {name: catalog.read_published(spark, _SNAPSHOTS[key], name) for name in catalog.DERIVED}
