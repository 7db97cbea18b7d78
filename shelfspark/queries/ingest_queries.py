"""Ingest semantics over events as a feed of records, and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans import ingest as runs
from shelfspark.session import table
from shelfspark.sources import raw_store
from shelfspark.streaming import ingest


def _feed(s, d, until="true"):
    e = table(s, d, "events").where(until)
    return e.select(F.lpad(F.col("user_id").cast("string"), 9, "0").alias("ppn"), F.to_json(F.struct("event_type", "props")).alias("record"), F.col("event_id").alias("seq"))


def upsert_latest(s, d):
    return raw_store.latest(_feed(s, d), "seq").select("ppn", "record")


def upsert(s, d):
    """Two runs: the first half of the month, then all of it."""
    feed = _feed(s, d)
    first = raw_store.latest(_feed(s, d, "ts < '2024-01-16'"), "seq").select("ppn", "record")
    second = raw_store.latest(feed, "seq").select("ppn", "record")
    return raw_store.put(raw_store.put(raw_store.empty(s), first, "T1"), second, "T2", True).select("ppn", "record", "first_seen", "updated_at")


def tombstones(s, d):
    feed = _feed(s, d)
    store = raw_store.put(raw_store.empty(s), raw_store.latest(feed, "seq").select("ppn", "record"), "T1")
    seen = feed.where("seq % 3 = 0").select("ppn").distinct()
    return raw_store.mark_removed(store, raw_store.missing(store, seen), "T2").select("ppn", "removed_at")


def gate(s, d):
    feed = _feed(s, d)
    store = raw_store.put(raw_store.empty(s), raw_store.latest(feed, "seq").select("ppn", "record"), "T1")
    gone = raw_store.missing(store, feed.where("seq % 3 = 0").select("ppn").distinct())
    n, m = raw_store.live(store).agg(F.count(F.lit(1)).alias("live")), gone.agg(F.count(F.lit(1)).alias("gone"))
    return n.crossJoin(m).withColumn("refused", (F.col("live") >= raw_store.MIN_LIVE) & (F.col("gone") > raw_store.MAX_MISSING * F.col("live")))


def recency(s, d):
    feed = table(s, d, "events").select(F.col("user_id").alias("ppn"), F.col("event_id").alias("position"))
    return raw_store.first_appearance(feed).select("ppn", F.col("rank").cast("bigint").alias("rank"))


def streak(s, d):
    feed = table(s, d, "events").select("event_id", F.col("event_id").alias("position"), "event_type")
    return raw_store.streak_cut(feed, F.col("event_type") == "purchase", 12).select("event_id")


def completeness(s, d):
    cells = table(s, d, "documents").groupBy(F.concat_ws(":", "source", "lang").alias("cell"), F.col("source").alias("format")).agg(F.count(F.lit(1)).alias("got"))
    return raw_store.completeness(cells.select("cell", "got", (F.col("got") + 3).alias("claimed")), cells.select("cell", "format"), cells.groupBy("format").agg((F.sum("got") + 5).alias("claimed")))


def facet_sets(s, d):
    return raw_store.facet_sets(table(s, d, "events").select(F.col("user_id").alias("ppn"), F.col("event_type").alias("genre"))).select("ppn", F.array_join("names", ",").alias("names"))


def overlay(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("ppn"), "source", F.col("n_chars").alias("size"))
    new = table(s, d, "labels").select(F.col("doc_id").alias("ppn"), F.when(F.col("quality") == 1, "good").otherwise("").alias("source"), F.col("toxic").cast("bigint").alias("size"))
    return raw_store.overlay(docs, new).select("ppn", "source", "size")


def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


RECORD = "ppn string, slug string, title string, year int"


def _store(s, d):
    """Documents as stored records; every third has no slug."""
    docs = table(s, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("ppn"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("slug-"), "source")).alias("slug"), F.concat(F.lit("Boek "), "source").alias("title"), F.col("n_chars").cast("int").alias("year"))
    return raw_store.put(raw_store.empty(s), docs.select("ppn", raw_store.body(docs).alias("record")), "T1")


def _paged(s, d):
    html = table(s, d, "pages").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("ppn"), "html")
    return raw_store.put_pages(_store(s, d), html, "T2")


def reconciled(s, d):
    """An enumeration that misses one live record in fifty, and one that misses a half, which is refused."""
    store = _store(s, d)
    few, _ = raw_store.reconcile(store, store.where(F.col("ppn").cast("long") % 50 != 7), "T3")
    after, done = raw_store.reconcile(few, store.where(F.col("ppn").cast("long") % 2 == 0), "T4")
    return after.select("ppn", "removed_at", F.lit(done).alias("done"))


def synced(s, d):
    """A newest-first feed laid over the store until a run of 40 unchanged records."""
    docs = table(s, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("ppn"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("slug-"), "source")).alias("slug"), F.concat(F.lit("Boek "), "source").alias("title"), F.col("n_chars").cast("int").alias("year"))
    changed = (F.col("doc_id") < 30) & (F.col("doc_id") % 4 == 0) | (F.col("doc_id") == 500)
    fields = "ppn string, slug string, title string, year int, author string, publisher string, format string, summary string"
    feed = docs.withColumn("title", F.when(changed, "Nieuw").otherwise(F.col("title"))).select("ppn", "slug", "title", "year", *[F.lit(None).cast("string").alias(c) for c in ("author", "publisher", "format", "summary")], F.col("doc_id").alias("position"))
    after = runs.sync(_store(s, d), feed, fields, "T5", 40)
    return after.where("updated_at IS NOT NULL").select("ppn", F.get_json_object("record", "$.title").alias("title"), "updated_at")


ALL = {
    "store_counts": (lambda s, d: raw_store.counts(_paged(s, d)), "SELECT count(*) AS records, count(html) AS pages FROM documents LEFT JOIN pages ON page_id = doc_id"),
    "stored_pages": (lambda s, d: raw_store.pages(_paged(s, d)).select("ppn", F.md5("html").alias("digest")), "SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, md5(html) AS digest FROM documents JOIN pages ON page_id = doc_id"),
    "page_stamps": (lambda s, d: _paged(s, d).select("ppn", "first_seen", "detail_at"), "SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, 'T1' AS first_seen, CASE WHEN html IS NOT NULL THEN 'T2' END AS detail_at FROM documents LEFT JOIN pages ON page_id = doc_id"),
    "pages_to_fetch": (lambda s, d: raw_store.without_page(_paged(s, d)), "SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, 'slug-' || source AS slug FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT page_id FROM pages)"),
    "stored_records": (lambda s, d: raw_store.records(_store(s, d), RECORD).select("ppn", "slug", "title", "year", "first_seen"), "SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, CASE WHEN doc_id % 3 <> 0 THEN 'slug-' || source END AS slug, 'Boek ' || source AS title, n_chars::INTEGER AS year, 'T1' AS first_seen FROM documents"),
    "stored_record": (lambda s, d: raw_store.get(_store(s, d), "000000007").select("ppn", "record"), """SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, '{"ppn":"000000007","slug":"slug-' || source || '","title":"Boek ' || source || '","year":' || n_chars || '}' AS record FROM documents WHERE doc_id = 7"""),
    "reconcile": (reconciled, "SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, CASE WHEN doc_id % 50 = 7 AND (n < 1000 OR m <= 0.05 * n) THEN 'T3' WHEN doc_id % 2 <> 0 AND (l < 1000 OR k <= 0.05 * l) THEN 'T4' END AS removed_at, (l < 1000 OR k <= 0.05 * l) AS done FROM documents, (SELECT count(*) AS n, count(*) FILTER (doc_id % 50 = 7) AS m, count(*) FILTER (doc_id % 50 <> 7) AS l, count(*) FILTER (doc_id % 50 <> 7 AND doc_id % 2 <> 0) AS k FROM documents)"),
    "sync": (synced, """WITH f AS (SELECT doc_id, doc_id < 30 AND doc_id % 4 = 0 OR doc_id = 500 AS c FROM documents), g AS (SELECT *, sum(c::INT) OVER (ORDER BY doc_id) AS i FROM f),
      r AS (SELECT *, sum((NOT c)::INT) OVER (PARTITION BY i ORDER BY doc_id) AS run FROM g), e AS (SELECT min(doc_id) AS stop FROM r WHERE run = 40)
      SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, 'Nieuw' AS title, 'T5' AS updated_at FROM r, e WHERE c AND (stop IS NULL OR doc_id <= stop)"""),
    "upsert_latest": (upsert_latest, """SELECT lpad(user_id::VARCHAR, 9, '0') AS ppn, arg_max('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}', event_id) AS record FROM events GROUP BY user_id"""),
    "upsert": (upsert, """WITH f AS (SELECT lpad(user_id::VARCHAR, 9, '0') AS ppn, '{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}' AS r, event_id, ts FROM events),
      a AS (SELECT ppn, arg_max(r, event_id) AS r FROM f WHERE ts < '2024-01-16' GROUP BY ppn), b AS (SELECT ppn, arg_max(r, event_id) AS r FROM f GROUP BY ppn)
      SELECT ppn, coalesce(b.r, a.r) AS record, CASE WHEN a.r IS NULL THEN 'T2' ELSE 'T1' END AS first_seen, CASE WHEN a.r <> b.r THEN 'T2' END AS updated_at FROM a FULL JOIN b USING (ppn)"""),
    "tombstones": (tombstones, "SELECT lpad(user_id::VARCHAR, 9, '0') AS ppn, CASE WHEN count(*) FILTER (event_id % 3 = 0) = 0 THEN 'T2' END AS removed_at FROM events GROUP BY user_id"),
    "tombstone_gate": (gate, "SELECT count(*) AS live, count(*) FILTER (n = 0) AS gone, count(*) >= 1000 AND count(*) FILTER (n = 0) > 0.05 * count(*) AS refused FROM (SELECT count(*) FILTER (event_id % 3 = 0) AS n FROM events GROUP BY user_id)"),
    "first_seen": (recency, "SELECT user_id AS ppn, row_number() OVER (ORDER BY min(event_id)) - 1 AS rank FROM events GROUP BY user_id"),
    "streak_stop": (streak, """WITH e AS (SELECT event_id, event_type = 'purchase' AS c, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS g FROM events),
      r AS (SELECT event_id, sum((NOT c)::INT) OVER (PARTITION BY g ORDER BY event_id) AS run FROM e), s AS (SELECT min(event_id) AS stop FROM r WHERE run = 12)
      SELECT event_id FROM e, s WHERE stop IS NULL OR event_id <= stop"""),
    "completeness": (completeness, "WITH c AS (SELECT source, count(*) AS got FROM documents GROUP BY source, lang) SELECT bool_and(got >= got + 3 - greatest(20, (got + 3) // 100)) AS complete, bool_and(got >= got + 3) AS removal_safe FROM c"),
    "facet_sets": (facet_sets, "SELECT user_id AS ppn, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id"),
    "overlay_merge": (overlay, "SELECT doc_id AS ppn, CASE WHEN quality = 1 THEN 'good' ELSE source END AS source, CASE WHEN toxic = 1 THEN 1 ELSE n_chars END AS size FROM documents LEFT JOIN labels USING (doc_id)"),
    "json_props": (json_props, "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events"),
    "tumbling_events": (lambda s, d: ingest.tumbling(table(s, d, "events"), streaming=False).select("start", "event_type", "n", F.round("value", 4).alias("value")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "sliding_events": (lambda s, d: ingest.sliding(table(s, d, "events"), streaming=False), "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start"),
    "session_events": (lambda s, d: ingest.sessions(table(s, d, "events"), streaming=False), """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR)::INT AS new FROM events)) GROUP BY user_id, g"""),
}
