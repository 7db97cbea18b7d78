"""Parsers of pages, lists and files over markup made from documents, whose facts are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.session import table
from shelfspark.sources import files, lists, pages



def _id():
    return F.col("doc_id")


def _key():
    return F.lpad(_id().cast("string"), 9, "0")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def detail_pages(s, d):
    docs = table(s, d, "documents")
    twin = F.when(_id() % 4 == 0, _text('<dt>Ook beschikbaar als:</dt><dd><a href="/catalogus/', _id() + 1, '/boek">Luisterboek</a></dd>')).otherwise("")
    html = _text(
        "<html><head><title>Boek ", _id(), " | ", F.when(_id() % 2 == 0, "E-book").otherwise("Luisterboek"), ' | Bibliotheek</title><link rel="canonical" href="https://www.onlinebibliotheek.nl/catalogus/', _key(), "/boek-", F.col("source"),
        '"><meta name="description" content="Over ', F.col("source"), '"></head><body><span class="title">Boek ', _id(), '</span><span class="creator">Naam ', F.col("source"), '</span><span class="creator">Naam Twee</span><p class="devicetypes">',
        F.when(_id() % 6 == 0, '<span class="ereader">x</span>').otherwise(""), "</p><dl><dt>Taal:</dt><dd>Frans</dd><dt>Uitgever</dt><dd>Huis ", F.col("lang"), "</dd><dt>Verschenen</dt><dd>in ", 1950 + _id() % 70, "</dd><dt>Aantal pagina's</dt><dd>1.", _id() % 900 + 100,
        " p.</dd><dt>Serie</dt><dd>Reeks ", _id() % 9, " (", _id() % 5, ")</dd><dt>Onderwerpen</dt><dd>een | twee</dd><dt>Onderwerpen: Jeugd</dt><dd><a href=\"?onderwerp=4.", _id() % 3, '">Genre ', _id() % 3, "</a></dd>", twin, "</dl></body></html>",
    )
    found = pages.parse_details(docs.select(F.lit(None).cast("string").alias("ppn"), html.alias("html")))
    genre = F.concat_ws(":", F.col("genres")[0]["code"], F.col("genres")[0]["name"])
    return found.select("ppn", "slug", "title", "author", "format", "summary", "ereader", "language", "publisher", "year", "pages", "series", "series_no", "audience", F.array_join("keywords", "/").alias("keywords"), F.array_join("subjects", "/").alias("subjects"), genre.alias("genre"), F.array_join("related_ppns", "/").alias("related"))


def listing_pages(s, d):
    """A results page for each document, but every tenth page is none."""
    docs = table(s, d, "documents")
    extent = F.when(_id() % 2 == 0, _text(_id() % 300 + 20, " pagina's (ePub2, 1,5 MB)")).otherwise(_text(_id() % 9 + 1, " uur (MP3) 20 MB"))
    card = _text('<p class="totalresults">1-1 van 1.', _id() % 900 + 100, '</p><ul class="rich-list"><li><a class="image-link" href="/catalogus/', _key(), '/boek"></a><span class="title">Boek</span><span class="creator">Naam |</span><p class="', F.when(_id() % 2 == 0, "medium ebook").otherwise("medium digitalaudiobook"), '">x</p><p class="additional">Non-fictie</p><p class="additional">Frans | ', extent, " | Huis ", F.col("source"), " | ", 1950 + _id() % 70, '</p></li></ul><a href="zoekresultaten.catalogus.', _id() % 40 + 2, '.html">n</a>')
    html = F.when(_id() % 10 == 0, "<html><p>Storing</p></html>").otherwise(card)
    found = pages.parse_listings(docs.select(_key().alias("page"), html.alias("html")))
    return found.select("page", "ppn", "format", "category", "language", "pages", "features", "duration", "size", "publisher", "year", "max_page", "total", "is_results")


def prizes(s, d):
    """A prize page for each source: a heading a document, a winner and a nominee."""
    entry = _text("== ", 1900 + _id() % 120, " ==\n* ''Boek ", _id(), "'' by [[Naam ", _id(), "]]\n=== Genomineerd ===\n* ''Ook ", _id(), "'' by [[Twee ", _id(), "]]\n")
    text = table(s, d, "documents").groupBy(F.col("source").alias("list")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "").alias("wikitext"))
    return lists.prize_pages(text).select("list", "year", "title", "author", "won")


def cards(s, d):
    card = _text('<span class="card__position">', _id(), '</span><h3 class="card__title" title="Boek ', _id(), ' &amp; meer">x</h3><div class="card__author"><a href="#">Naam ', F.col("lang"), "</a></div><p>ISBN 978", F.lpad(_id().cast("string"), 10, "0"), "</p>")
    html = table(s, d, "documents").groupBy(F.col("source").alias("list")).agg(F.array_join(F.collect_list(F.concat(card, card)), "").alias("html"))
    return lists.bestseller_cards(html).select("list", "position", "title", "author", "isbn")


#: Document numbers that an overview spans.
OVERVIEW_SPAN = 1000


def _overviews(s, d):
    """API overviews of the books of a source, of OVERVIEW_SPAN document numbers each: a source's books are no single text."""
    book = F.struct(_id().cast("int").alias("rank"), _text("THE BOOK ", _id()).alias("title"), F.col("lang").alias("author"), F.when(_id() % 2 == 0, _text("978", F.lpad(_id().cast("string"), 10, "0"))).otherwise("").alias("primary_isbn13"), F.lpad(_id().cast("string"), 10, "0").alias("primary_isbn10"), F.lit("img").alias("book_image"))
    one = F.struct(F.lit("1").alias("list_id"), F.lit("N").alias("list_name"), F.col("source").alias("list_name_encoded"), F.lit("").alias("display_name"), F.col("books"))
    by = table(s, d, "documents").groupBy("source", F.floor(_id() / OVERVIEW_SPAN)).agg(F.collect_list(book).alias("books"))
    json = F.to_json(F.struct(F.struct(F.array(one).alias("lists")).alias("results")))
    return by.select(json.alias("json"))


def overview(s, d):
    return lists.api_overview(_overviews(s, d)).select("list", "name", "position", "title", "author", "isbn")


def key_pairs(s, d):
    """Files of addresses, of lines, of a JSON array and of an object, one a document."""
    body = F.when(_id() % 4 == 0, _text("https://x/catalogus/", _id(), "/boek-", _id(), "?a=1\n\n")).when(_id() % 4 == 1, _text("ppn,slug\n", _id(), ", boek-", _id())).when(_id() % 4 == 2, _text('[{"ppn":"', _id(), '","slug":"boek-', _id(), '"},{"url":"/catalogus/', _id(), '/nog"}]')).otherwise(_text('{"url":"/catalogus/', _id(), "/boek-", _id(), '"}'))
    return files.pairs(table(s, d, "documents").select(body.alias("value")))


def sitemaps(s, d):
    works = table(s, d, "documents").select(_key().alias("work_id"))
    out = files.sitemap(works, works.select("work_id", F.lit("boek").alias("slug")), "https://x.nl")
    return out.select("page", F.regexp_count("xml", F.lit("<loc>")).cast("long").alias("n"))


ALL = {
    "detail_pages": (detail_pages, """SELECT lpad(doc_id::VARCHAR, 9, '0') AS ppn, 'boek-' || source AS slug, 'Boek ' || doc_id AS title, 'Naam ' || source || ' ; Naam Twee' AS author, CASE WHEN doc_id % 2 = 0 THEN 'ebook' ELSE 'audiobook' END AS format,
      'Over ' || source AS summary, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 6 = 0)::INTEGER END AS ereader, 'Frans' AS language, 'Huis ' || lang AS publisher, (1950 + doc_id % 70)::INTEGER AS year, (1000 + doc_id % 900 + 100)::INTEGER AS pages,
      'Reeks ' || (doc_id % 9) AS series, (doc_id % 5)::INTEGER AS series_no, 'Jeugd' AS audience, 'een/twee' AS keywords, 'Genre ' || (doc_id % 3) AS subjects, '4.' || (doc_id % 3) || ':Genre ' || (doc_id % 3) AS genre, CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1)::VARCHAR END AS related FROM documents"""),
    "listing_pages": (listing_pages, """SELECT lpad(doc_id::VARCHAR, 9, '0') AS page, CASE WHEN r THEN lpad(doc_id::VARCHAR, 9, '0') END AS ppn, CASE WHEN r THEN CASE WHEN e THEN 'ebook' ELSE 'audiobook' END END AS format, CASE WHEN r THEN 'nonfictie' END AS category, CASE WHEN r THEN 'Frans' END AS language,
      CASE WHEN r AND e THEN (doc_id % 300 + 20)::INTEGER END AS pages, CASE WHEN r AND e THEN 'ePub2' END AS features, CASE WHEN r AND NOT e THEN (doc_id % 9 + 1) || ' uur 20 MB' END AS duration, CASE WHEN r THEN CASE WHEN e THEN '1,5 MB' ELSE '20 MB' END END AS size,
      CASE WHEN r THEN 'Huis ' || source END AS publisher, CASE WHEN r THEN (1950 + doc_id % 70)::INTEGER END AS year, CASE WHEN r THEN (doc_id % 40 + 2)::INTEGER ELSE 1 END AS max_page, CASE WHEN r THEN (1000 + doc_id % 900 + 100)::INTEGER END AS total, r AS is_results FROM (SELECT *, doc_id % 10 <> 0 AS r, doc_id % 2 = 0 AS e FROM documents)"""),
    "prize_entries": (prizes, "SELECT source AS list, (1900 + doc_id % 120)::INTEGER AS year, unnest(['Boek ' || doc_id, 'Ook ' || doc_id]) AS title, unnest(['Naam ' || doc_id, 'Twee ' || doc_id]) AS author, unnest([1, 0])::INTEGER AS won FROM documents"),
    "bestsellers": (cards, "SELECT source AS list, doc_id::INTEGER AS position, 'Boek ' || doc_id || ' & meer' AS title, 'Naam ' || lang AS author, '978' || lpad(doc_id::VARCHAR, 10, '0') AS isbn FROM documents"),
    "book_overview": (overview, "SELECT 'nyt-' || source AS list, 'NYT — N' AS name, doc_id::INTEGER AS position, 'The Book ' || doc_id AS title, lang AS author, CASE WHEN doc_id % 2 = 0 THEN '978' ELSE '' END || lpad(doc_id::VARCHAR, 10, '0') AS isbn FROM documents"),
    "key_pairs": (key_pairs, "SELECT doc_id::VARCHAR AS ppn, 'boek-' || doc_id AS slug FROM documents UNION ALL SELECT doc_id::VARCHAR, 'nog' FROM documents WHERE doc_id % 4 = 2"),
    "book_sitemaps": (sitemaps, "SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 45000 + 1)::BIGINT AS page, 1::BIGINT AS n FROM documents"),
}
ALL["book_sitemaps"] = (sitemaps, f"SELECT page, count(*) AS n FROM ({ALL['book_sitemaps'][1]}) GROUP BY page")
