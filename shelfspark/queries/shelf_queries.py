"""Shelves, lists, links, side tables: the read layer over documents as editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import params
from shelfspark.operators import browse, similar
from shelfspark.plans import catalog, ingest
from shelfspark.plans.testdata import editions, snapshot
from shelfspark.queries import catalog_queries, sql
from shelfspark.session import table


def _lists(s, d):
    """A list for each source and one without slots; slots are documents, every third without a work."""
    docs = table(s, d, "documents")
    lists = docs.select(F.col("source").alias("slug"), F.concat(F.lit("Lijst "), "source").alias("name")).distinct().unionByName(s.createDataFrame([("leeg", "Lege lijst")], "slug string, name string"))
    work_of = snapshot(s, d)["editions"].select("ppn", "work_id")
    slots = docs.select(F.col("source").alias("list"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 3 != 0, F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("ppn"))
    return lists, slots.join(work_of, "ppn", "left").drop("ppn")


def _held(s, d):
    items = _lists(s, d)[1].where("work_id IS NOT NULL")
    return items.select("work_id", F.col("list").alias("slug"), "position", (2000 + F.col("position") % 20).cast("int").alias("year"))


def _contents(s, d, show):
    return browse.list_contents(_lists(s, d)[1], snapshot(s, d)["works"], show).select("list", "position", "work_id", "has_ebook")


def _author_lists(s, d):
    t = snapshot(s, d)
    return browse.author_lists(browse.author_shelf(t["works"], t["work_authors"], "anna vrij"), _held(s, d), _lists(s, d)[0])


def _side_tables(s, d):
    """Removed rows, known e-readers, crawled genres and recency laid over the records."""
    e = editions(s, d).withColumn("removed_at", F.when(F.col("doc_id") % 11 == 0, "T")).withColumn("first_seen", F.when(F.col("doc_id") % 2 == 0, "2020").otherwise("2030")).withColumn("ereader", F.lit(None).cast("int"))
    key = F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("ppn")
    docs = table(s, d, "documents")
    known, crawled, recent = docs.where("doc_id % 5 = 0").select(key), docs.where("doc_id % 7 = 0").select(key, F.array(F.lit("Genre 1"), F.lit("Nieuw")).alias("names")), docs.where("doc_id % 13 = 0").select(key, F.col("doc_id").cast("int").alias("rank"))
    out = catalog.transform(e, ereader=known, ereader_stamp="2025", genres=crawled, recent=recent)
    return out.select("ppn", "ereader", F.array_join("subjects", "/").alias("subjects"), "added_rank")


def _prior_flags(s, d):
    """Without e-reader data the last build's flags stay."""
    e = editions(s, d).withColumn("ereader", F.lit(None).cast("int"))
    prior = table(s, d, "documents").where("doc_id % 5 = 0").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("ppn"), (F.col("doc_id") % 2).cast("int").alias("ereader"))
    return catalog.transform(e, prior=prior).select("ppn", "ereader")


def _false_splits(s, d):
    t = snapshot(s, d)
    label = F.when(F.col("doc_id") % 4 == 0, "Luisterboek").when(F.col("doc_id") % 4 == 1, "E-book")
    return browse.false_splits(t["editions"].withColumn("also_available_as", label), t["works"])


def _shown(s, d):
    t = snapshot(s, d)
    return browse.shown_genres(t["work_genres"], t["works"], catalog.genre_parents(catalog_queries._tagged(s, d)))


def _nested_tree(s, d):
    pages, tree = catalog_queries._taxonomy(s, d)
    kids = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["slug"], c["titles"])), ",")
    return browse.genre_tree(tree, pages, "volwassenen").select("slug", "name", "titles", kids.alias("children"))


def _edges(s, d):
    docs = table(s, d, "documents")
    key = lambda c: F.lpad(c.cast("string"), 9, "0")
    return docs.select(key(F.col("doc_id")).alias("work_id"), F.lit(0).alias("rank"), key(F.col("doc_id") + 1).alias("other"), F.lit(0.5).alias("score"), F.when(F.col("doc_id") % 2 == 0, "lsa").otherwise("old").alias("method"))


def _neighbours(s, d):
    edges = _edges(s, d).withColumn("work_id", F.lit("000000001")).withColumn("rank", F.col("other").cast("int")).withColumn("method", F.lit("lsa"))
    return similar.neighbours_of(edges, snapshot(s, d)["works"], "000000001", limit=15).select("work_id", "author", "score")


def _landing(s, d):
    f = params.SearchFilters(format="audiobook", year_from=1995, sort="year_desc")
    return browse.landing(snapshot(s, d)["works"], f).select("work_id", "year")


def _ordered(s, d, sort):
    return params.page(params.ordered(snapshot(s, d)["works"], sort), 2, 96).select("work_id")


_ITEMS = """, items AS (
  SELECT source AS list, doc_id AS position, CASE WHEN doc_id % 3 <> 0 THEN work_id END AS work_id FROM documents JOIN work_of ON ppn = lpad(doc_id::VARCHAR, 9, '0')
)"""
_with = lambda body: f"WITH RECURSIVE {sql.CATALOG_SQL}{_ITEMS} {body}"
_CONTENTS = "SELECT list, position, work_id, has_ebook FROM items LEFT JOIN works USING (work_id)"
_NOCASE = "translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE trim(coalesce(nullif(regexp_extract(left({x}, {n}), '^(.+)-[^-]*$', 1), ''), left({x}, {n})), '-') END"
_SLUGS = f"""SELECT work_id, array_to_string(list_filter([{_CUT('s', 60)}, {_CUT('p', 40)}], lambda x: x <> ''), '--') AS slug FROM (
  SELECT work_id, {sql.slug('title')} AS s, coalesce({sql.slug('name')}, '') AS p FROM works LEFT JOIN (
    SELECT work_id, arg_min(author_key, (position, author_key)) AS author_key FROM work_authors GROUP BY work_id) USING (work_id) LEFT JOIN authors USING (author_key))"""
_TREE = f"""WITH RECURSIVE {sql.CATALOG_SQL}{catalog_queries._TREES}, own AS (
  SELECT slug, name, t.titles, t.parent_slug FROM genre_tree t JOIN genre_pages USING (slug) WHERE audience = 'volwassenen'
) SELECT slug, name, titles, coalesce(children, '') AS children FROM own LEFT JOIN (
  SELECT parent_slug AS slug, string_agg(slug || ':' || titles, ',' ORDER BY -titles, slug) AS children FROM own WHERE parent_slug <> '' GROUP BY parent_slug) USING (slug) WHERE parent_slug = ''"""
_SHOWN = f"""WITH RECURSIVE {sql.CATALOG_SQL}{catalog_queries._PARENTS}, f AS (
  SELECT work_id, g.genre, parent FROM work_genres g JOIN works w USING (work_id) LEFT JOIN parents p ON p.genre = g.genre AND p.audience = lower(coalesce(w.audience, ''))
) SELECT * FROM f WHERE parent IS NOT NULL OR (work_id, genre) NOT IN (SELECT (work_id, parent) FROM f WHERE parent IS NOT NULL)"""

ALL = {
    "series_shelf": (lambda s, d: browse.series_shelf(snapshot(s, d)["works"], "de-reeks-10").select("work_id", "series_no", "year"), sql.with_catalog(f"SELECT work_id, series_no, year FROM works WHERE {sql.slug('series')} = 'de-reeks-10' ORDER BY series_no NULLS FIRST, year NULLS FIRST, work_id LIMIT 300")),
    "series_index": (lambda s, d: browse.series_index(snapshot(s, d)["series"]).select("slug", "titles"), sql.with_catalog(f"SELECT {sql.slug('series')} AS slug, count(*) AS titles FROM works WHERE series <> '' GROUP BY 1")),
    "authors_in_letter": (lambda s, d: browse.authors_in_letter(snapshot(s, d)["authors"], "W"), sql.with_catalog("SELECT name, n_works AS titles FROM authors WHERE surname_letter = 'W'")),
    "author_index": (lambda s, d: browse.author_index(snapshot(s, d)["authors"]), sql.with_catalog("SELECT name, name_fold, surname_sort, first_sort, n_works AS titles FROM authors")),
    "work_ref": (lambda s, d: browse.work_ref(snapshot(s, d)["works"], snapshot(s, d)["editions"], "000000051"), sql.with_catalog("SELECT work_id FROM work_of WHERE ppn = '000000051'")),
    "work_slug_table": (lambda s, d: snapshot(s, d)["slugs"], sql.with_catalog(_SLUGS)),
    "lists_overview": (lambda s, d: browse.lists_overview(*_lists(s, d), "pct").select("slug", "total", F.col("available").cast("long").alias("available")), _with("SELECT list AS slug, count(*) AS total, count(work_id) AS available FROM items GROUP BY list UNION ALL SELECT 'leeg', 0, 0")),
    "list_contents": (lambda s, d: _contents(s, d, "all"), _with(_CONTENTS)),
    "list_available": (lambda s, d: _contents(s, d, "available"), _with(f"{_CONTENTS} WHERE work_id IS NOT NULL")),
    "list_unavailable": (lambda s, d: _contents(s, d, "unavailable"), _with(f"{_CONTENTS} WHERE work_id IS NULL")),
    "lists_of_works": (lambda s, d: browse.lists_of(snapshot(s, d)["works"].where("has_ebook = 1"), _held(s, d)).select("work_id", F.array_join(F.transform("lists", lambda x: F.concat_ws(":", x["position"], x["slug"])), ",").alias("lists")), _with("SELECT work_id, string_agg(position || ':' || list, ',' ORDER BY position, list) AS lists FROM items JOIN works USING (work_id) WHERE has_ebook = 1 GROUP BY work_id")),
    "author_lists": (_author_lists, _with(f"SELECT list AS slug, 'Lijst ' || list AS name, max(2000 + position % 20)::INTEGER AS year FROM items JOIN (SELECT work_id FROM works JOIN work_authors USING (work_id) WHERE author_key = 'anna vrij' ORDER BY year DESC NULLS LAST, {_NOCASE}, work_id LIMIT 300) USING (work_id) GROUP BY list")),
    "landing_page": (_landing, sql.with_catalog("SELECT work_id, year FROM works WHERE has_audiobook = 1 AND year >= 1995 ORDER BY year DESC NULLS LAST, work_id LIMIT 120")),
    "order_added": (lambda s, d: _ordered(s, d, "added"), sql.with_catalog("SELECT work_id FROM works ORDER BY added_rank NULLS LAST, work_id LIMIT 96 OFFSET 96")),
    "order_title": (lambda s, d: _ordered(s, d, "title"), sql.with_catalog(f"SELECT work_id FROM works ORDER BY {_NOCASE} NULLS FIRST, work_id LIMIT 96 OFFSET 96")),
    "order_year_asc": (lambda s, d: _ordered(s, d, "year_asc"), sql.with_catalog("SELECT work_id FROM works ORDER BY year NULLS FIRST, work_id LIMIT 96 OFFSET 96")),
    "false_splits": (_false_splits, sql.with_catalog("SELECT e.ppn, e.title FROM enriched e JOIN works w USING (work_id) WHERE doc_id % 4 = 0 AND has_audiobook = 0 OR doc_id % 4 = 1 AND has_ebook = 0")),
    "shown_genres": (_shown, _SHOWN),
    "genre_tree_nested": (_nested_tree, _TREE),
    "audiences": (lambda s, d: browse.audiences(catalog_queries._taxonomy(s, d)[1]), f"WITH RECURSIVE {sql.CATALOG_SQL}{catalog_queries._TREES} SELECT DISTINCT audience FROM genre_tree"),
    "side_tables": (_side_tables, sql.with_editions("""SELECT ppn, CASE WHEN format = 'ebook' THEN CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 2 = 0 THEN 0 END END AS ereader,
      array_to_string(CASE WHEN doc_id % 7 = 0 THEN list_concat(subjects, list_filter(['Genre 1', 'Nieuw'], lambda x: NOT list_contains(subjects, x))) ELSE subjects END, '/') AS subjects,
      CASE WHEN doc_id % 13 = 0 THEN doc_id::INTEGER ELSE added_rank END AS added_rank FROM editions WHERE doc_id % 11 <> 0""")),
    "prior_flags": (_prior_flags, sql.with_editions("SELECT ppn, CASE WHEN format = 'ebook' AND doc_id % 5 = 0 THEN (doc_id % 2)::INTEGER END AS ereader FROM editions")),
    "similar_works": (_neighbours, sql.with_catalog("SELECT work_id, author, 0.5::DOUBLE AS score FROM works JOIN documents ON lpad((doc_id + 1)::VARCHAR, 9, '0') = work_id ORDER BY work_id LIMIT 15")),
    "similar_methods": (lambda s, d: ingest.replace_method(_edges(s, d).unionByName(_edges(s, d).withColumn("method", F.lit("kept"))), _edges(s, d).where("method = 'lsa'").withColumn("score", F.lit(0.25)), ("lsa", "kept")).groupBy("method", "score").agg(F.count(F.lit(1)).alias("n")), "SELECT 'kept' AS method, 0.5::DOUBLE AS score, count(*) AS n FROM documents UNION ALL SELECT 'lsa', 0.25, count(*) FILTER (doc_id % 2 = 0) FROM documents"),
}
