"""The catalog build and its read layer, over documents as editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import params
from shelfspark.operators import browse, graph, search
from shelfspark.plans import catalog, grouping
from shelfspark.plans.testdata import editions, snapshot
from shelfspark.queries import sql


def _build(s, d):
    return snapshot(s, d)


def _works(s, d):
    return catalog.build(editions(s, d))["works"].withColumn("summary", F.md5("summary"))


def _components(s, d):
    from shelfspark.session import table

    docs = table(s, d, "documents").select("doc_id", F.md5("text").alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("v"))
    edges = docs.join(first, "k").select(F.col("doc_id").alias("u"), "v").unionByName(docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("u"), (F.col("doc_id") - 7).alias("v")).where("v >= 0"))
    roots = graph.components(edges)
    return docs.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


def _facets(s, d):
    t = _build(s, d)
    lists = s.createDataFrame([], "slug string, name string")
    f = browse.facets(t["works"], t["genres"], t["publishers"], t["authors"], lists)
    pick = lambda k, c: f[k].select(F.lit(k).alias("kind"), F.col(c).alias("value"))
    return pick("formats", "format").unionByName(pick("languages", "language")).unionByName(pick("genres", "name")).unionByName(pick("publishers", "name")).unionByName(pick("authors", "name"))


def _filtered(s, d):
    t = _build(s, d)
    f = params.SearchFilters(format="ebook", languages=("Engels", "Frans"), authors=("BOB de wit", "Anna Vrij"), genres=("Genre 1", "Genre 2"), year_from=1995, year_to=2020, sort="year_desc")
    return params.page(params.ordered(params.filtered(t["works"], f, t["work_authors"], t["work_genres"]), f.sort), 1, 48).select("work_id", "title", "year")


def _top_authors(s, d):
    t = _build(s, d)
    return browse.top_authors(t["works"].where("language = 'Engels'"), t["work_authors"], t["authors"])


def _dashboard(s, d):
    t = _build(s, d)
    return browse.dashboard_counts(t["works"], t["editions"], t["authors"], t["publishers"])


def _shelf(s, d):
    t = _build(s, d)
    return browse.author_shelf(t["works"], t["work_authors"], "bob de wit").select("work_id", "year")


def _match_lists(s, d):
    e = editions(s, d).withColumn("isbn", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("978-"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))))
    items = e.where("doc_id % 4 = 0").select((F.col("doc_id") % 5).cast("string").alias("list"), F.col("doc_id").cast("int").alias("position"), "title", "author", F.when(F.col("doc_id") % 8 == 0, F.translate("isbn", "-", "")).alias("isbn"))
    work_of = e.select("ppn", F.col("ppn").alias("work_id"))
    return catalog.match_lists(items, e, work_of).select("list", "position", "work_id")


def _detail(s, d):
    t = _build(s, d)
    none = s.createDataFrame([], "audience string, genre string, parent string")
    row = browse.book_detail("000000001", t["works"], t["editions"], t["work_authors"], t["authors"], t["work_genres"], none)
    return row.select("work_id", F.size("editions").alias("n_editions"), F.array_join(F.transform("authors", lambda x: x["name"]), "/").alias("names"), F.array_join(F.transform("genres", lambda x: x["genre"]), "/").alias("genres"))


def _spelled(s, d):
    t = _build(s, d)
    return catalog.pooled_text(t["editions"], t["work_genres"]).select("work_id", F.md5(F.concat_ws("|", "title", "author", "subjects", "summary")).alias("digest"))


def _tagged(s, d):
    code = F.substring_index(F.col("subjects")[0], " ", -1)
    top = F.struct(F.concat(code, F.lit(".0")).alias("code"), F.col("subjects")[0].alias("name"))
    sub = F.struct(F.concat(code, F.lit("."), (F.substring_index(F.col("subjects")[1], " ", -1).cast("int") + 1).cast("string")).alias("code"), F.col("subjects")[1].alias("name"))
    return editions(s, d).select("ppn", "audience", F.array(top, sub).alias("genres"))


def _taxonomy(s, d):
    t = _build(s, d)
    return catalog.genre_taxonomy(t["work_genres"], catalog.genre_parents(_tagged(s, d)), t["works"])


def _browse_paths(s, d):
    t = _build(s, d)
    return browse.browse_paths(t["authors"], t["series"], _taxonomy(s, d)[0], browse.publisher_pages(t["publishers"]))


_PARENTS = """, tagged AS (
  SELECT lower(trim(coalesce(audience, ''))) AS aud, ppn, unnest([1, 2]) AS pos, unnest(subjects) AS genre,
    unnest([string_split(subjects[1], ' ')[-1] || '.0', string_split(subjects[1], ' ')[-1] || '.' || (string_split(subjects[2], ' ')[-1]::INTEGER + 1)]) AS code FROM editions
), coded AS (
  SELECT aud, genre, arg_min(code, (ppn, pos)) AS code, count(*) AS n FROM tagged GROUP BY ALL
), tops AS (
  SELECT aud, code, arg_min(genre, (-n, genre)) AS parent FROM coded GROUP BY ALL
), parents AS (
  SELECT c.aud AS audience, c.genre, t.parent FROM coded c JOIN tops t ON t.aud = c.aud AND t.code = string_split(c.code, '.')[1] || '.0' WHERE string_split(c.code, '.')[2] <> '0' AND t.parent <> c.genre
)"""
_TREES = f"""{_PARENTS}, placed AS (
  SELECT g.work_id, g.genre, {sql.slug('g.genre')} AS slug, {sql.slug('parent')} AS pslug, CASE WHEN lower(w.audience) = 'jeugd' THEN 'jeugd' ELSE 'volwassenen' END AS aud
  FROM work_genres g JOIN works w USING (work_id) LEFT JOIN parents p ON p.genre = g.genre AND p.audience = lower(coalesce(w.audience, ''))
), genre_pages AS (
  SELECT slug, name, titles, CASE WHEN parent <> slug THEN parent ELSE '' END AS parent_slug
  FROM (SELECT slug, arg_min(genre, (-length(genre), genre)) AS name, count(DISTINCT work_id) AS titles FROM placed GROUP BY slug)
  JOIN (SELECT slug, arg_min(pslug, (-n, pslug)) AS parent FROM (SELECT slug, pslug, count(*) AS n FROM placed GROUP BY ALL) GROUP BY slug) USING (slug)
), per AS (
  SELECT aud, slug, count(DISTINCT work_id) AS titles FROM placed GROUP BY ALL
), genre_tree AS (
  SELECT per.aud AS audience, per.slug, coalesce(parent, '') AS parent_slug, titles FROM per LEFT JOIN (
    SELECT aud, slug, arg_min(pslug, (-n, pslug)) AS parent FROM (SELECT aud, slug, pslug, count(*) AS n FROM placed WHERE pslug <> '' AND pslug <> slug AND (aud, pslug) IN (SELECT (aud, slug) FROM per) GROUP BY ALL) GROUP BY ALL) USING (aud, slug)
)"""
_PAGES = "SELECT replace(name_fold, ' ', '-') AS slug, sum(n) AS titles FROM publishers WHERE name_fold <> '' GROUP BY ALL"
_SERIES = f"SELECT {sql.slug('series')} AS slug, count(*) AS titles FROM works WHERE series <> '' GROUP BY ALL"
_PICK = "SELECT work_id, title, author, md5(summary) AS summary, publisher, year, language, series, series_no, audience, keywords, has_ebook, has_audiobook, ereader, ebook_ppn, audiobook_ppn, n_editions, added_rank FROM works"
_LIMITED = lambda kind, col, frm, n: f"SELECT '{kind}' AS kind, value FROM (SELECT {col} AS value FROM {frm} LIMIT {n})"

ALL = {
    "work_groups": (lambda s, d: grouping.group_editions(editions(s, d)), sql.with_groups("SELECT ppn, work_id FROM work_of")),
    "components": (_components, """WITH RECURSIVE e AS (
      SELECT doc_id AS u, min(doc_id) OVER (PARTITION BY text) AS v FROM documents UNION ALL SELECT doc_id, doc_id - 7 FROM documents WHERE doc_id % 7 = 0 AND doc_id >= 7
    ), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
    SELECT u AS doc_id, min(v) AS root FROM r GROUP BY u"""),
    "works_rollup": (_works, sql.with_catalog(_PICK)),
    "editions_enriched": (lambda s, d: _build(s, d)["editions"].select("ppn", "work_id", "author", "publisher", "language"), sql.with_catalog("SELECT ppn, work_id, author, publisher, language FROM enriched")),
    "work_author_links": (lambda s, d: _build(s, d)["work_authors"], sql.with_catalog("SELECT work_id, author_key, position FROM work_authors")),
    "author_table": (lambda s, d: _build(s, d)["authors"], sql.with_catalog("SELECT * FROM authors")),
    "genre_counts": (lambda s, d: _build(s, d)["genres"], sql.with_catalog("SELECT name, n_works FROM genres")),
    "publisher_table": (lambda s, d: _build(s, d)["publishers"], sql.with_catalog("SELECT * FROM publishers")),
    "language_table": (lambda s, d: _build(s, d)["languages"], sql.with_catalog("SELECT * FROM languages")),
    "series_table": (lambda s, d: _build(s, d)["series"], sql.with_catalog(f"SELECT slug, arg_min(series, (-n, series)) AS name, sum(n)::BIGINT AS titles FROM (SELECT {sql.slug('series')} AS slug, series, count(*) AS n FROM works WHERE series <> '' GROUP BY ALL) GROUP BY slug")),
    "search_text": (_spelled, sql.with_catalog("SELECT work_id, md5(concat_ws('|', t, a, coalesce(g, '') || ' ' || k, sm)) AS digest FROM (SELECT work_id, coalesce(string_agg(DISTINCT summary, ',' ORDER BY summary), '') AS sm, string_agg(DISTINCT title, ',' ORDER BY title) AS t, coalesce(string_agg(DISTINCT author, ',' ORDER BY author), '') AS a, coalesce(string_agg(DISTINCT keywords, ',' ORDER BY keywords), '') AS k FROM enriched GROUP BY work_id) LEFT JOIN (SELECT work_id, string_agg(genre, ' ' ORDER BY genre) AS g FROM work_genres GROUP BY work_id) USING (work_id)")),
    "facet_panel": (_facets, sql.with_catalog(" UNION ALL ".join(["SELECT 'formats' AS kind, unnest(['audiobook', 'ebook']) AS value", _LIMITED("languages", "language", "(SELECT language, count(*) AS n FROM works WHERE language IS NOT NULL AND length(language) <= 24 GROUP BY ALL ORDER BY n DESC, language)", 25), _LIMITED("genres", "name", "(SELECT * FROM genres ORDER BY n_works DESC, name)", 40), _LIMITED("publishers", "name", "(SELECT * FROM publishers ORDER BY n DESC, name)", 80), _LIMITED("authors", "name", "(SELECT * FROM authors ORDER BY n_works DESC, name)", 120)]))),
    "filtered_page": (_filtered, sql.with_catalog("SELECT work_id, title, year FROM works WHERE has_ebook = 1 AND language IN ('Engels', 'Frans') AND year BETWEEN 1995 AND 2020 AND work_id IN (SELECT work_id FROM work_authors WHERE author_key IN ('bob de wit', 'anna vrij')) AND work_id IN (SELECT work_id FROM work_genres WHERE genre IN ('Genre 1', 'Genre 2')) ORDER BY year DESC, work_id LIMIT 48")),
    "browse_summary": (lambda s, d: browse.slice_summary(_build(s, d)["works"].where("language = 'Duits'")), sql.with_catalog("SELECT sum(has_ebook)::BIGINT AS ebooks, sum(has_audiobook)::BIGINT AS audiobooks, coalesce(sum(ereader), 0)::BIGINT AS ereader, min(nullif(year, 0)) AS year_min, max(year) AS year_max FROM works WHERE language = 'Duits'")),
    "top_authors": (_top_authors, sql.with_catalog("SELECT name, count(*) AS titles FROM work_authors JOIN works USING (work_id) JOIN authors USING (author_key) WHERE language = 'Engels' GROUP BY name, name_fold ORDER BY titles DESC, name_fold LIMIT 8")),
    "stats_dashboard": (_dashboard, sql.with_catalog("SELECT (SELECT count(*) FROM works) AS total, (SELECT count(*) FROM works WHERE has_ebook = 1) AS ebooks, (SELECT count(*) FROM works WHERE has_audiobook = 1) AS audiobooks, (SELECT count(*) FROM works WHERE ereader = 1) AS ereader, (SELECT count(DISTINCT language) FROM works) AS languages, (SELECT count(*) FROM enriched) AS editions, (SELECT count(*) FROM authors) AS authors, (SELECT count(DISTINCT name_fold) FROM publishers) AS publishers")),
    "year_histogram": (lambda s, d: browse.year_histogram(_build(s, d)["works"]), sql.with_catalog("SELECT year, count(*) AS n FROM works WHERE year >= 2000 GROUP BY year")),
    "group_sizes": (lambda s, d: browse.group_sizes(_build(s, d)["works"]), sql.with_catalog("SELECT n_editions, count(*) AS n FROM works GROUP BY n_editions")),
    "letter_counts": (lambda s, d: browse.letter_counts(_build(s, d)["authors"]), sql.with_catalog("SELECT surname_letter AS letter, count(*) AS n FROM authors GROUP BY 1")),
    "author_shelf": (_shelf, sql.with_catalog("SELECT work_id, year FROM works JOIN work_authors USING (work_id) WHERE author_key = 'bob de wit' ORDER BY year DESC NULLS LAST, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), work_id LIMIT 300")),
    "publisher_pages": (lambda s, d: browse.publisher_pages(_build(s, d)["publishers"]), sql.with_catalog("SELECT replace(name_fold, ' ', '-') AS slug, arg_min(name, (-n, -length(name), name)) AS name, sum(n)::BIGINT AS titles FROM publishers WHERE name_fold <> '' GROUP BY name_fold")),
    "suspicious_merges": (lambda s, d: browse.suspicious_merges(_build(s, d)["editions"]), sql.with_catalog(f"SELECT work_id, min(title) AS title, count(*) AS n, count(DISTINCT language) AS langs, max(year) - min(nullif(year, 0)) AS span, count(DISTINCT {sql.publisher_key('publisher')}) AS pubs FROM enriched GROUP BY work_id HAVING n > 1 AND (langs > 1 OR span > 5 OR pubs > 1)")),
    "match_lists": (_match_lists, sql.with_editions(f"""SELECT list, position, CASE WHEN row_number() OVER (PARTITION BY list, w ORDER BY position) = 1 THEN w END AS work_id FROM (
      SELECT (doc_id % 5)::VARCHAR AS list, doc_id::INTEGER AS position, coalesce(CASE WHEN doc_id % 24 = 0 THEN ppn END, first) AS w FROM (SELECT *, {sql.fold('title')} || '|' || string_split({sql.fold('author')}, ' ')[-1] AS k FROM editions WHERE doc_id % 4 = 0)
      LEFT JOIN (SELECT k, min(ppn) AS first FROM (SELECT ppn, {sql.fold('title')} || '|' || string_split({sql.fold("CASE WHEN " + sql.fold('a') + " = 'bernlef' THEN 'J. Bernlef' ELSE a END")}, ' ')[-1] AS k FROM (SELECT ppn, title, unnest(CASE WHEN len({sql.split_authors('author')}) > 0 THEN {sql.split_authors('author')} ELSE [author] END) AS a FROM editions)) GROUP BY k) USING (k))""")),
    "book_detail": (_detail, sql.with_catalog("SELECT work_id, (SELECT count(*)::INTEGER FROM enriched e WHERE e.work_id = w.work_id) AS n_editions, (SELECT string_agg(name, '/' ORDER BY position, name) FROM work_authors a JOIN authors USING (author_key) WHERE a.work_id = w.work_id) AS names, (SELECT string_agg(genre, '/' ORDER BY genre) FROM work_genres g WHERE g.work_id = w.work_id) AS genres FROM works w WHERE work_id = '000000001'")),
    "facet_search": (lambda s, d: search.facet_values(_build(s, d)["authors"], _build(s, d)["publishers"], "publisher", "Uitgeverij"), sql.with_catalog("SELECT name AS value, n FROM publishers WHERE contains(name_fold, 'uitgeverij') ORDER BY n DESC, name LIMIT 30")),
    "genre_spellings": (lambda s, d: browse.genre_spellings(_build(s, d)["genres"], "onderwerp-1"), sql.with_catalog(f"SELECT name FROM genres WHERE {sql.fold('name')} = 'onderwerp 1'")),
    "sitemap_pages": (lambda s, d: browse.sitemap_pages(editions(s, d).withColumnRenamed("ppn", "work_id"), 100), "SELECT lpad(doc_id::VARCHAR, 9, '0') AS work_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1)::BIGINT AS page FROM documents"),
    "leading_editions": (lambda s, d: browse.leading_editions(_build(s, d)["editions"]), sql.with_catalog("SELECT work_id, format, min(ppn) AS ppn FROM enriched GROUP BY ALL")),
    "genre_parents": (lambda s, d: catalog.genre_parents(_tagged(s, d)), f"WITH {sql.EDITIONS_SQL}{_PARENTS} SELECT * FROM parents"),
    "genre_pages": (lambda s, d: _taxonomy(s, d)[0], f"WITH RECURSIVE {sql.CATALOG_SQL}{_TREES} SELECT * FROM genre_pages"),
    "genre_tree": (lambda s, d: _taxonomy(s, d)[1], f"WITH RECURSIVE {sql.CATALOG_SQL}{_TREES} SELECT * FROM genre_tree"),
    "genre_children": (lambda s, d: browse.genre_children(_taxonomy(s, d)[0], ""), f"WITH RECURSIVE {sql.CATALOG_SQL}{_TREES} SELECT slug, name, titles FROM genre_pages WHERE parent_slug = ''"),
    "browse_sitemap": (_browse_paths, f"""WITH RECURSIVE {sql.CATALOG_SQL}{_TREES} SELECT unnest(['/auteurs', '/genres', '/e-books', '/luisterboeken']) AS path UNION ALL SELECT DISTINCT '/auteurs/' || lower(surname_letter) FROM authors
      UNION ALL SELECT '/auteur/' || first_sort FROM authors WHERE n_works >= 2 UNION ALL SELECT '/reeks/' || slug FROM ({_SERIES}) WHERE titles >= 2
      UNION ALL SELECT '/genre/' || slug FROM genre_pages WHERE titles >= 2 UNION ALL SELECT '/uitgever/' || slug FROM ({_PAGES}) WHERE titles >= 2"""),
    "series_sniff": (lambda s, d: catalog.transform(editions(s, d).drop("series", "series_no").withColumn("title", F.concat(F.lit("Reeks "), (F.col("doc_id") % 9).cast("string"), F.lit(": deel "), (F.col("doc_id") % 5).cast("string")))).select("ppn", "series", "series_no"), sql.with_editions("SELECT ppn, 'Reeks ' || (doc_id % 9) AS series, (doc_id % 5)::INTEGER AS series_no FROM editions")),
}

