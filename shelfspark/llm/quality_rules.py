"""Quality rules over words and lines, and cross-document line frequency by host.

A line is normalised (lower case, single spaces) and hashed. For each host the number of distinct
texts that hold a line is counted; exact copies of a text count once, so that copying a document
does not condemn it. Lines above the limit are boilerplate of the host and are removed everywhere but
in the document with the smallest doc_id that holds them. A document that loses nearly all it had is
rejected. Everything is DataFrame functions; the text is read once for all measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import workspace

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is frequent in a host if more distinct texts hold it than both of these.
MAX_DOCS, MAX_DOC_SHARE = 50, 0.001
#: A document is depleted if it keeps fewer words than MIN_WORDS or than this share of its words.
MIN_LEFT_PERCENT = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def line_hash(line: Column) -> Column:
    """Hash of a line's words in lower case, single spaces between them."""
    return _hash_words(_words(line))


def _hash_words(words: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def base_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and __lines: hash and words of each line.

    A null text has no words. Five-word windows are compared by a 64-bit hash of their words; only
    texts in which some window repeats are sorted by it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, WHITE_CHARS, "")
    df = docs.withColumn("__raw", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__by_line", F.transform("__raw", _words)).withColumn("__solid", solid)
    df = df.withColumn("__words", F.flatten("__by_line")).withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length("__solid").cast("long"))
    df = df.withColumn("n_symbols", F.col("word_chars") - F.length(F.translate("__solid", SYMBOLS, "")))
    df = df.withColumn("n_dup_lines", (F.size("__raw") - F.size(F.array_distinct("__raw"))).cast("long"))
    windows = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(5)]))
    df = df.withColumn("__windows", F.when(F.col("n_words") > 5, windows))
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(repeats, placed))
    same = lambda x, k: F.coalesce(F.get(F.col("__sorted"), k)["h"] == x["h"], F.lit(False))
    found = F.array_sort(F.transform(F.filter("__sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    df = df.withColumn("__found", found)
    covered = F.aggregate("__found", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn("__lines", F.transform("__by_line", lambda w: F.struct(_hash_words(w).alias("h"), F.size(w).alias("n"))))
    return df.drop("__raw", "__by_line", "__solid", "__words", "__windows", "__sorted", "__found")


def frequent_lines(digest: DataFrame) -> DataFrame:
    """host, h, first: lines above the limits, and the smallest doc_id that holds them.

    One row of each distinct text of a host stands for its copies; counts are combined before they
    are shuffled, so a line that every document holds costs a row a task.
    """
    copies = digest.groupBy("host", "text_hash").agg(F.min("doc_id").alias("first"), F.min_by("__lines", "doc_id").alias("lines"))
    hosts = copies.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    held = copies.select("host", "first", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).where(F.col("docs") > MAX_DOCS)
    return counts.join(hosts, "host").where(F.col("docs") > MAX_DOC_SHARE * F.col("texts")).select("host", "h", "first")


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, host, text_hash, the measures, base_failed, kept, and removed (hashes of lines to remove).

    docs needs doc_id, text and source (the host; null is one host of its own, as the empty string).
    Rows alike in all three are judged alike. Rows with no words, null or empty texts fail the base.
    An empty table gives no rows.
    """
    read = docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit("")).alias("host"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    digest = workspace.materialize(base_measures(read).drop("text"), "line_digest")
    held = digest.select("doc_id", "host", "text_hash", F.explode("__lines").alias("x")).select("doc_id", "host", "text_hash", F.col("x.h").alias("h"))
    frequent = workspace.broadcast_if_small(workspace.materialize(frequent_lines(digest), "frequent_lines"))
    hit = held.join(frequent, ["host", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = hit.groupBy(F.col("doc_id").alias("k1"), F.col("host").alias("k2"), F.col("text_hash").alias("k3")).agg(F.collect_set("h").alias("removed"))
    judged = digest.join(workspace.shuffled(lost), F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("host") == F.col("k2")) & (F.col("text_hash") == F.col("k3")), "left")
    gone = F.aggregate(F.filter("__lines", lambda x: F.array_contains("removed", x["h"])), F.lit(0), lambda a, x: a + x["n"])
    judged = judged.withColumn("left_words", F.col("n_words") - F.when(F.col("removed").isNull(), F.lit(0)).otherwise(gone))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    whole = (F.col("left_words") >= MIN_WORDS) & (100 * F.col("left_words") >= MIN_LEFT_PERCENT * F.col("n_words"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words"]
    return judged.select("doc_id", "host", "text_hash", *measures, failed.alias("base_failed"), (~failed & whole).alias("kept"), "removed")


def clean(docs: DataFrame) -> DataFrame:
    """docs without rejected rows, frequent lines removed from the texts of the rest; n_chars, if there, follows the text.

    Columns of docs may have any names.
    """
    verdict = judge(docs).where("kept").select("doc_id", "host", "text_hash", "removed").dropDuplicates(["doc_id", "host", "text_hash"])
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.coalesce(F.col("doc.source"), F.lit("")) == F.col("host")) & (F.xxhash64(text) == F.col("text_hash"))
    kept = docs.select(F.struct(*docs.columns).alias("doc")).join(workspace.shuffled(verdict), same)
    left = F.array_join(F.filter(F.split("doc.text", "\n", -1), lambda x: ~F.array_contains("removed", line_hash(x))), "\n")
    kept = kept.withColumn("left", F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(left))
    out = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("removed").isNull(), F.col("doc.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, host, text, array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' ') AS norm,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, host, text, unnest(ls) AS l FROM w)
), hosts AS (
  SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host
), freq AS (
  SELECT host, norm, count(DISTINCT text) AS docs, min(doc_id) AS first FROM ln GROUP BY host, norm HAVING count(DISTINCT text) > 50
), lost AS (
  SELECT ln.doc_id, sum(ln.n) AS n FROM ln JOIN freq USING (host, norm) JOIN hosts USING (host)
  WHERE docs > 0.001 * texts AND ln.doc_id <> first GROUP BY ln.doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(ws) - coalesce(lost.n, 0) AS left_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND left_words >= 10 AND 100 * left_words >= 20 * n_words AS kept,
       left_words::BIGINT AS left_words
FROM f
"""
