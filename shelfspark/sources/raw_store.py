"""The raw record store: change-detecting upserts, tombstones, gates, incremental sync.

A store is a table of RAW rows, one a key: the record as canonical JSON, its page, four stamps. Every
operation takes a store and gives the next one, so a store is published like any other snapshot and
a run that fails leaves the last one as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = "ppn string, record string, detail_html string, first_seen string, updated_at string, detail_at string, removed_at string"
STAMPS = ("first_seen", "updated_at", "detail_at", "removed_at")
SIGNATURE = ("title", "author", "year", "publisher", "format", "summary")
STREAK, MIN_LIVE, MAX_MISSING = 120, 1000, 0.05


def empty(spark: SparkSession) -> DataFrame:
    """A store without records."""
    return spark.createDataFrame([], RAW)


def body(df: DataFrame) -> Column:
    """Canonical JSON of a record: fields in order of name, stamps left out, nulls dropped."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in STAMPS]))


def records(store: DataFrame, schema: str) -> DataFrame:
    """Records with their stamps, by a declared schema; the page is not read."""
    return store.select(F.from_json("record", schema).alias("r"), *STAMPS).select("r.*", *STAMPS)


def pages(store: DataFrame) -> DataFrame:
    """ppn, html of stored pages."""
    return store.where(F.col("detail_html").isNotNull()).select("ppn", F.col("detail_html").alias("html"))


def without_page(store: DataFrame) -> DataFrame:
    """Records still to fetch: no page, and a slug to fetch it by."""
    return store.where(F.col("detail_html").isNull() & F.get_json_object("record", "$.slug").isNotNull()).select("ppn", F.get_json_object("record", "$.slug").alias("slug"))


def live(store: DataFrame) -> DataFrame:
    """Keys that are not marked removed."""
    return store.where(F.col("removed_at").isNull()).select("ppn")


def get(store: DataFrame, ppn: str) -> DataFrame:
    """One record."""
    return store.where(F.col("ppn") == ppn)


def counts(store: DataFrame) -> DataFrame:
    """Records and pages."""
    return store.agg(F.count(F.lit(1)).alias("records"), F.count("detail_html").alias("pages"))


def latest(rows: DataFrame, seq: str) -> DataFrame:
    """The last row of each key by seq; ties to the greatest record. An aggregate: no window sorts a hot key."""
    rest = F.struct(*[F.col(c) for c in rows.columns if c != "ppn"])
    ordered = F.struct(F.col(seq).alias("seq"), *([F.col("record").alias("record")] if "record" in rows.columns else []))
    return rows.groupBy("ppn").agg(F.max_by(rest, ordered).alias("r")).select("ppn", "r.*")


def put(store: DataFrame, new: DataFrame, now: str, is_live: bool = False) -> DataFrame:
    """Upsert ppn, record: inserts are stamped first_seen, changed bodies updated_at, equal ones nothing.

    is_live: the rows were just seen in the catalog, which takes a removal mark back. new has a row a
    key; use latest() first where it may not.
    """
    joined = store.join(new.select("ppn", F.col("record").alias("new")), "ppn", "full_outer")
    seen, fresh = F.col("new").isNotNull(), F.col("record").isNull() & F.col("first_seen").isNull()
    changed = seen & ~fresh & ~F.col("new").eqNullSafe(F.col("record"))
    return joined.select(
        "ppn",
        F.coalesce("new", "record").alias("record"),
        "detail_html",
        F.when(seen & fresh, F.lit(now)).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        "detail_at",
        F.when(seen & F.lit(is_live), F.lit(None)).otherwise(F.col("removed_at")).cast("string").alias("removed_at"),
    )


def put_pages(store: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Attach pages (ppn, html) to records."""
    joined = store.join(new.select("ppn", F.col("html").alias("__html")), "ppn", "left")
    got = F.col("__html").isNotNull()
    return joined.withColumn("detail_at", F.when(got, F.lit(now)).otherwise(F.col("detail_at"))).withColumn("detail_html", F.coalesce("__html", "detail_html")).select(*store.columns)


def overlay(base: DataFrame, new: DataFrame, key: str = "ppn") -> DataFrame:
    """Rows of both by key; a field of new wins if it says something (not null, empty, 0 or an empty list)."""
    kinds = dict(new.dtypes)
    own = [c for c in new.columns if c != key]

    def says(c: str) -> Column:
        x = F.col(f"__new_{c}")
        if kinds[c] == "string":
            return F.nullif(x, F.lit(""))
        if kinds[c].startswith("array"):
            return F.when(F.size(x) > 0, x)
        return F.nullif(x, F.lit(0)) if kinds[c] in ("int", "bigint", "double") else x

    joined = base.join(new.select(key, *[F.col(c).alias(f"__new_{c}") for c in own]), key, "full_outer")
    merged = [F.coalesce(says(c), F.col(c)) if c in base.columns else says(c) for c in own]
    return joined.select(key, *[m.alias(c) for m, c in zip(merged, own, strict=True)], *[c for c in base.columns if c != key and c not in own])


def missing(store: DataFrame, seen: DataFrame) -> DataFrame:
    """Live keys that an enumeration did not see."""
    return live(store).join(seen.select("ppn"), "ppn", "left_anti")


def mark_removed(store: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """Stamp removed_at once; a mark that is there keeps its date."""
    joined = store.join(gone.select("ppn", F.lit(True).alias("__gone")).distinct(), "ppn", "left")
    return joined.withColumn("removed_at", F.when(F.col("__gone"), F.coalesce("removed_at", F.lit(now))).otherwise(F.col("removed_at"))).select(*store.columns)


def reconcile(store: DataFrame, seen: DataFrame, now: str, max_share: float = MAX_MISSING) -> tuple[DataFrame, bool]:
    """mark_removed on what is missing, unless so much is that the enumeration must have a hole."""
    gone = missing(store, seen)
    n_live, n_gone = live(store).count(), gone.count()
    if n_live >= MIN_LIVE and n_gone > max_share * n_live:
        return store, False
    return mark_removed(store, gone, now), True


def first_appearance(feed: DataFrame, key: str = "ppn", position: str = "position") -> DataFrame:
    """key, rank from 0 in order of first appearance in a newest-first feed.

    The feed of one run is bounded by its page limit, so ranking it is one small task.
    """
    first = feed.groupBy(key).agg(F.min(position).alias("first"))
    return first.select(key, (F.row_number().over(W.orderBy("first", key)) - 1).alias("rank"))


def streak_cut(feed: DataFrame, changed: Column, streak: int = STREAK, position: str = "position") -> DataFrame:
    """The feed up to and with the row that completes a run of `streak` unchanged rows; all of it without one.

    A run is an island between changes. Its place in the feed is a running count, so a whole feed is
    ordered once; the feed of a run is bounded by its page limit.
    """
    flagged = feed.withColumn("__changed", F.coalesce(changed, F.lit(True)))
    island = F.sum(F.col("__changed").cast("int")).over(W.orderBy(position))
    numbered = flagged.withColumn("__island", island)
    run = F.sum((~F.col("__changed")).cast("int")).over(W.partitionBy("__island").orderBy(position))
    stops = numbered.withColumn("__run", run).where(F.col("__run") == streak).agg(F.min(position).alias("__stop"))
    return flagged.crossJoin(F.broadcast(stops)).where(F.col("__stop").isNull() | (F.col(position) <= F.col("__stop"))).drop("__stop", "__changed")  # one row of stops


def changed_against(feed: DataFrame, known: DataFrame) -> DataFrame:
    """feed with `changed`: new, back from removal, or another value in a signature field that says something."""
    old = known.select("ppn", F.lit(True).alias("__known"), F.col("removed_at").alias("__removed"), *[F.col(c).alias(f"__old_{c}") for c in SIGNATURE])
    joined = feed.join(old, "ppn", "left")
    told = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0")
    differs = F.lit(False)
    for c in SIGNATURE:
        differs = differs | (told(c) & ~F.col(c).eqNullSafe(F.col(f"__old_{c}")))
    changed = F.col("__known").isNull() | F.col("__removed").isNotNull() | differs
    return joined.withColumn("changed", changed).drop("__known", "__removed", *[f"__old_{c}" for c in SIGNATURE])


def completeness(cells: DataFrame, expected: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """complete, removal_safe of a walk, one row.

    expected: cell, format of every cell that there is; cells: cell, got, claimed (null: not said) of
    those that ran; formats: format, claimed of the unfiltered counts. A cell that did not run, or a
    shortfall beyond the noise of a moving catalog, makes it incomplete; any shortfall at all makes
    it unsafe to conclude removals from.
    """
    short = lambda got, claimed: got < claimed - F.greatest(F.lit(20), F.floor(claimed / 100))
    ran = expected.join(cells, "cell", "left")
    verdict = ran.agg(F.every(F.col("got").isNotNull() & ~F.coalesce(short(F.col("got"), F.col("claimed")), F.lit(False))).alias("covered"), F.every(F.coalesce(F.col("got") >= F.col("claimed"), F.lit(True))).alias("exact"))
    if formats is None:
        return verdict.select(F.col("covered").alias("complete"), (F.col("covered") & F.col("exact")).alias("removal_safe"))
    sums = ran.groupBy("format").agg(F.every(F.col("claimed").isNotNull()).alias("counted"), F.sum("claimed").alias("cells_claim"))
    whole = sums.join(formats.withColumnRenamed("claimed", "format_claims"), "format", "left").agg(F.every(F.coalesce(~(F.col("counted") & short(F.col("cells_claim"), F.col("format_claims"))), F.lit(True))).alias("languages"))
    both = verdict.crossJoin(F.broadcast(whole))  # one row each
    complete = F.col("covered") & F.col("languages")
    return both.select(complete.alias("complete"), (complete & F.col("exact")).alias("removal_safe"))


def facet_sets(tags: DataFrame) -> DataFrame:
    """ppn, names: the set of genres that a facet crawl met each record under, sorted."""
    return tags.groupBy("ppn").agg(F.array_sort(F.collect_set("genre")).alias("names"))


def guarded(new: DataFrame, prior: DataFrame, complete: bool) -> DataFrame:
    """A side table's new state, or the last complete one."""
    return new if complete else prior
