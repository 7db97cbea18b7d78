"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import display, params, text
from shelfspark.plans.testdata import editions
from shelfspark.queries import sql
from shelfspark.session import table
from shelfspark.sources import lists, pages


def _docs(s, d):
    return table(s, d, "documents")


def _select(df, *cols):
    return df.select(*cols)


MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in display.MONTHS) + "]"
_FLAT = "trim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\"“”''')"
_CAP = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE trim(coalesce(nullif(regexp_extract(left({x}, {n}), '^(.+)-[^-]*$', 1), ''), left({x}, {n})), '-') END"

ALL = {
    "fold_docs": (lambda s, d: _docs(s, d).select("doc_id", text.fold("text").alias("folded")), f"SELECT doc_id, {sql.fold('text')} AS folded FROM documents"),
    "slug_parts": (lambda s, d: table(s, d, "part").select("p_partkey", text.slugify("p_name").alias("slug"), display.path("genre", "p_type").alias("path")), f"SELECT p_partkey, {sql.slug('p_name')} AS slug, '/genre/' || {sql.slug('p_type')} AS path FROM part"),
    "surname_keys": (lambda s, d: editions(s, d).select("ppn", text.surname_key("author").alias("surname"), text.letter(text.surname_key("author")).alias("letter")), sql.with_editions(f"SELECT ppn, coalesce({sql.surname('author')}, '') AS surname, CASE WHEN upper(left({sql.surname('author')}, 1)) BETWEEN 'A' AND 'Z' THEN upper(left({sql.surname('author')}, 1)) ELSE 'overig' END AS letter FROM editions")),
    "split_names": (lambda s, d: editions(s, d).select("ppn", F.array_join(text.split_authors("author"), "/").alias("names")), sql.with_editions(f"SELECT ppn, array_to_string({sql.split_authors('author')}, '/') AS names FROM editions")),
    "publisher_keys": (lambda s, d: editions(s, d).select("ppn", text.publisher_key("publisher").alias("pub_key"), text.canonical_publisher("publisher").alias("canonical")), sql.with_editions(f"SELECT ppn, {sql.publisher_key('publisher')} AS pub_key, {sql.canonical_publisher('publisher', 'publisher')} AS canonical FROM editions")),
    "author_aliases": (lambda s, d: editions(s, d).select("ppn", F.explode(text.split_authors("author")).alias("name")).select("ppn", text.canonical_author("name").alias("name"), text.author_key("name").alias("author_key")), sql.with_editions(f"SELECT ppn, CASE WHEN {sql.fold('n')} = 'bernlef' THEN 'J. Bernlef' ELSE n END AS name, {sql.fold('n')} AS author_key FROM (SELECT ppn, unnest({sql.split_authors('author')}) AS n FROM editions)")),
    "match_keys": (lambda s, d: editions(s, d).select("ppn", text.match_key("title", "author").alias("match_key")), sql.with_editions(f"SELECT ppn, {sql.fold('title')} || '|' || string_split({sql.fold('author')}, ' ')[-1] AS match_key FROM editions")),
    "series_detect": (lambda s, d: editions(s, d).select("ppn", text.detect_series(F.concat(F.coalesce("series", F.lit("Los")), F.lit(": deel "), (F.col("doc_id") % 12).cast("string"))).alias("x")).select("ppn", "x.series", "x.series_no"), sql.with_editions("SELECT ppn, coalesce(series, 'Los') AS series, (doc_id % 12)::INTEGER AS series_no FROM editions")),
    "strip_noise": (lambda s, d: editions(s, d).select("ppn", text.strip_format_noise("title").alias("title")), sql.with_editions(f"SELECT ppn, trim({sql.strip_noise('title')}) AS title FROM editions")),
    "language_codes": (lambda s, d: editions(s, d).select("ppn", text.valid_language("language").alias("language"), text.language_code("language").alias("code")), sql.with_editions("SELECT ppn, language, CASE language WHEN 'Engels' THEN 'en' WHEN 'Frans' THEN 'fr' WHEN 'Duits' THEN 'de' WHEN 'Spaans' THEN 'es' END AS code FROM editions")),
    "work_slugs": (lambda s, d: editions(s, d).select("ppn", text.work_slug("title", "author").alias("slug"), display.book_path(text.work_slug("title", "author"), "ppn").alias("path")), sql.with_editions(f"SELECT ppn, array_to_string(list_filter([a, b], lambda x: x <> ''), '--') AS slug, '/boek/' || array_to_string(list_filter([a, b, ppn], lambda x: x <> ''), '--') AS path FROM (SELECT ppn, {_CAP(sql.slug('title'), 60)} AS a, {_CAP(sql.slug('author'), 40)} AS b FROM editions)")),
    "isbn_digits": (lambda s, d: table(s, d, "pages").select("page_id", text.isbn_digits("url").alias("digits")), r"SELECT page_id, regexp_replace(url, '\D', '', 'g') AS digits FROM pages"),
    "snippets": (lambda s, d: _docs(s, d).select("doc_id", display.snippet("text").alias("snippet")), f"SELECT doc_id, CASE WHEN length(t) <= 155 THEN t WHEN contains(left(t, 155), ' ') THEN rtrim(regexp_extract(left(t, 155), '^(.*) ', 1), ' ,;:-–—') || '…' ELSE left(t, 155) || '…' END AS snippet FROM (SELECT doc_id, {_FLAT} AS t FROM documents)"),
    "dutch_dates": (lambda s, d: table(s, d, "orders").select("o_orderkey", display.nl_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("said")), f"SELECT o_orderkey, day(o_orderdate) || ' ' || {MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) AS said FROM orders"),
    "dutch_numbers": (lambda s, d: table(s, d, "orders").select("o_orderkey", display.nl_number("o_orderkey").alias("number"), display.rounded("o_orderkey").alias("rounded")), "SELECT o_orderkey, replace(format('{:,}', o_orderkey), ',', '.') AS number, CASE WHEN o_orderkey >= 1000 THEN (o_orderkey // 1000) || '.000+' ELSE o_orderkey::VARCHAR END AS rounded FROM orders"),
    "short_durations": (lambda s, d: table(s, d, "part").select("p_partkey", display.short_duration(F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_size") % 12).cast("string"), F.lit(" uur "), (F.col("p_partkey") % 60).cast("string"), F.lit(" minuten"))).otherwise(F.concat((F.col("p_size") % 12).cast("string"), F.lit(":"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit(":09")))).alias("short")), "SELECT p_partkey, CASE WHEN h > 0 AND m > 0 THEN h || ' u ' || m || ' min' WHEN h > 0 THEN h || ' u' ELSE m || ' min' END AS short FROM (SELECT p_partkey, p_size % 12 AS h, p_partkey % 60 AS m FROM part)"),
    "cover_widths": (lambda s, d: table(s, d, "pages").select("page_id", display.cover_width("url").alias("plain"), display.cover_width(F.concat("url", F.lit("?width=320"))).alias("asked")), "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'width=400' AS plain, url || '?width=400' AS asked FROM pages"),
    "slug_phrases": (lambda s, d: table(s, d, "part").select("p_partkey", display.slug_words(text.slugify("p_name")).alias("phrase"), display.is_wordy(text.slugify("p_name")).alias("wordy")), f"SELECT p_partkey, trim(replace({sql.slug('p_name')}, '-', ' ')) AS phrase, regexp_full_match({sql.slug('p_name')}, '(?i)[a-z][a-z0-9]{{2,}}(-[a-z0-9]+)*') AS wordy FROM part"),
    "year_parse": (lambda s, d: table(s, d, "events").select("event_id", params.year_column(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise((F.col("event_id") * 7).cast("string"))).alias("year")), "SELECT event_id, CASE WHEN n BETWEEN -9999 AND 9999 THEN n END AS year FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::INTEGER WHEN event_id % 3 = 2 THEN (event_id * 7)::INTEGER END AS n FROM events)"),
    "sitemap_entries": (lambda s, d: table(s, d, "pages").select("page_id", display.sitemap_entry("https://x.nl", F.concat(F.lit("/a&b/"), F.col("url"))).alias("entry")), "SELECT page_id, '<url><loc>https://x.nl' || replace(replace(replace('/a&b/' || url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc></url>' AS entry FROM pages"),
    "breadcrumb_json": (lambda s, d: table(s, d, "part").select("p_partkey", display.breadcrumbs("https://x.nl", (F.lit("Genres"), F.lit("/genres")), (F.col("p_type"), F.lit(""))).alias("json")), """SELECT p_partkey, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"https://x.nl/"},{"@type":"ListItem","position":2,"name":"Genres","item":"https://x.nl/genres"},{"@type":"ListItem","position":3,"name":"' || p_type || '"}]}' AS json FROM part"""),
    "week_ranges": (lambda s, d: table(s, d, "part").select("p_partkey", lists.week_range(F.concat(F.lit("Week "), (F.col("p_partkey") % 52 + 1).cast("string"), F.lit(" - "), (2019 + F.col("p_size") % 8).cast("string"))).alias("range")), f"""SELECT p_partkey, 'week ' || w || ' · ' || CASE WHEN month(m) = month(s) THEN day(m)::VARCHAR WHEN year(m) = year(s) THEN day(m) || ' ' || {MONTHS_SQL}[month(m)] ELSE day(m) || ' ' || {MONTHS_SQL}[month(m)] || ' ' || year(m) END || ' t/m ' || day(s) || ' ' || {MONTHS_SQL}[month(s)] || ' ' || year(s) AS range
      FROM (SELECT *, m + INTERVAL 6 DAY AS s FROM (SELECT p_partkey, p_partkey % 52 + 1 AS w, date_trunc('week', make_date((2019 + p_size % 8)::BIGINT, 1, 4)) + to_days((7 * (p_partkey % 52))::INTEGER) AS m FROM part))"""),
    "title_case": (lambda s, d: table(s, d, "part").select("p_partkey", lists.title_case(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("title")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE p_name END AS title FROM part"),
    "page_fields": (lambda s, d: table(s, d, "pages").select("page_id", pages.title_of("html").alias("title"), F.length(pages.visible_text("html")).cast("bigint").alias("n_visible")), r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_visible FROM pages"""),
}
