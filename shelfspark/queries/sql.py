"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from shelfspark.plans.testdata import EDITIONS_SQL

PARTICLES = "van|de|der|den|het|ten|ter|te|op|aan|in|du|des|del|della|la|le|di|da|dos|von|zu|af|t"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def slug(x: str) -> str:
    return f"replace({fold(x)}, ' ', '-')"


def surname(x: str) -> str:
    """Good for names with at least a first name and a surname before particles and suffixes, as the test data has."""
    bare = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\([^)]*\\)', ' ', 'g'), '[’''`]', '', 'g')"
    for a, b in (("ø", "o"), ("Ø", "O"), ("ß", "ss"), ("æ", "ae")):
        bare = f"replace({bare}, '{a}', '{b}')"
    off = f"regexp_replace({fold(bare)}, '( (e v a|e a|c s|et al|jr|sr|{PARTICLES}))+$', '')"
    return f"string_split({off}, ' ')[-1]"


def publisher_key(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '[]', ''), '\\s+', ' ', 'g'), ' .,')"


def split_authors(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\s*[|;]\\s*'), lambda a: trim(a, ' ,')), lambda a: a <> '')"


def first_author(x: str) -> str:
    return f"{split_authors(x)}[1]"


def strip_noise(x: str) -> str:
    return f"regexp_replace({x}, '\\s*[-–—:;]?\\s*\\b(luisterboek|e-book)\\s*$', '')"


def canonical_publisher(x: str, fallback: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN contains({fold(x)}, 'correspondent') THEN 'De Correspondent, Amsterdam' ELSE {fallback} END"


#: Editions with work_id: connected components of key buckets and cross-links, least e-book as the representative.
GROUPED_SQL = f"""{EDITIONS_SQL}, keyed AS (
  SELECT ppn, format, related, {fold(strip_noise('title'))} AS tkey, {surname(first_author('author'))} AS skey, {fold('language')} AS lang FROM editions
), heads AS (
  SELECT tkey, coalesce(skey, '') AS skey, lang, min(ppn) AS head FROM keyed WHERE tkey <> '' AND lang <> '' GROUP BY ALL
), lone AS (
  SELECT tkey, skey, min(head) AS head FROM heads GROUP BY ALL HAVING count(*) = 1
), edges AS (
  SELECT ppn AS u, head AS v FROM keyed JOIN heads ON keyed.tkey = heads.tkey AND coalesce(keyed.skey, '') = heads.skey AND keyed.lang = heads.lang
  UNION SELECT ppn, head FROM keyed JOIN lone ON keyed.tkey = lone.tkey AND coalesce(keyed.skey, '') = lone.skey WHERE lang = '' AND keyed.tkey <> ''
  UNION SELECT ppn, related FROM keyed WHERE related IN (SELECT ppn FROM keyed)
), both_ways AS (
  SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v
), reach(u, v) AS (
  SELECT ppn, ppn FROM keyed UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u
), root AS (
  SELECT u AS ppn, min(v) AS root FROM reach GROUP BY u
), rep AS (
  SELECT root, coalesce(min(CASE WHEN format = 'ebook' THEN ppn END), min(ppn)) AS work_id FROM root JOIN keyed USING (ppn) GROUP BY root
), work_of AS (
  SELECT ppn, work_id FROM root JOIN rep USING (root)
)"""

#: Enriched editions and the work roll-up.
CATALOG_SQL = f"""{GROUPED_SQL}, canon AS (
  SELECT k, arg_min(publisher, (-n, first)) AS canon FROM (
    SELECT {publisher_key('publisher')} AS k, publisher, count(*) AS n, min(ppn) AS first FROM editions WHERE publisher <> '' GROUP BY 1, 2) GROUP BY k
), enriched AS (
  SELECT e.* EXCLUDE (author, publisher), work_id, list_distinct_ordered AS authors,
    CASE WHEN len(list_distinct_ordered) > 0 THEN array_to_string(list_distinct_ordered, ', ') ELSE e.author END AS author,
    {canonical_publisher('e.publisher', 'coalesce(canon, e.publisher)')} AS publisher
  FROM (SELECT *, list_transform({split_authors('author')}, lambda a: CASE WHEN {fold('a')} = 'bernlef' THEN 'J. Bernlef' ELSE a END) AS list_distinct_ordered FROM editions) e
  JOIN work_of USING (ppn) LEFT JOIN canon ON k = {publisher_key('e.publisher')}
), grouped AS (
  SELECT work_id, arg_min(summary, (-length(summary), ppn)) FILTER (summary <> '') AS summary, min(nullif(year, 0)) AS year,
    max(language) AS l, max(series) AS s, max(series_no) AS sn, max(audience) AS a, max(keywords) AS k,
    max((format = 'ebook')::INTEGER) AS has_ebook, max((format = 'audiobook')::INTEGER) AS has_audiobook,
    max(CASE WHEN format = 'ebook' THEN ereader END) AS ereader, min(CASE WHEN format = 'ebook' THEN ppn END) AS ebook_ppn,
    min(CASE WHEN format = 'audiobook' THEN ppn END) AS audiobook_ppn, count(*) AS n_editions, min(added_rank) AS added_rank
  FROM enriched GROUP BY work_id
), works AS (
  SELECT g.work_id, r.title, r.author, g.summary, r.publisher, g.year, coalesce(r.language, l) AS language, coalesce(r.series, s) AS series,
    coalesce(r.series_no, sn) AS series_no, coalesce(r.audience, a) AS audience, coalesce(r.keywords, k) AS keywords,
    has_ebook, has_audiobook, g.ereader, ebook_ppn, audiobook_ppn, n_editions, g.added_rank
  FROM grouped g JOIN enriched r ON r.ppn = g.work_id
), work_genres AS (
  SELECT DISTINCT work_id, unnest(subjects) AS genre FROM enriched
), named AS (
  SELECT work_id, ppn, unnest(authors) AS name, generate_subscripts(authors, 1) - 1 AS position FROM enriched
), work_authors AS (
  SELECT work_id, {fold('name')} AS author_key, arg_min(position, (ppn, position))::INTEGER AS position FROM named GROUP BY ALL
), people AS (
  SELECT author_key, arg_min(name, (-n, name)) AS name FROM (SELECT {fold('name')} AS author_key, name, count(*) AS n FROM named GROUP BY ALL) GROUP BY ALL
), authors AS (
  SELECT author_key, name, {fold('name')} AS name_fold, {surname('name')} AS surname_sort, {slug('name')} AS first_sort,
    upper(left({surname('name')}, 1)) AS surname_letter, upper(left({slug('name')}, 1)) AS first_letter, n_works
  FROM people JOIN (SELECT author_key, count(*) AS n_works FROM work_authors GROUP BY ALL) USING (author_key)
), publishers AS (
  SELECT publisher AS name, {fold('publisher')} AS name_fold, count(*) AS n FROM enriched WHERE ppn = work_id AND publisher <> '' GROUP BY ALL
), languages AS (
  SELECT language AS name, {fold('language')} AS name_fold, count(*) AS n FROM enriched WHERE ppn = work_id AND language <> '' GROUP BY ALL
), genres AS (
  SELECT genre AS name, count(*) AS n_works FROM work_genres GROUP BY ALL
)"""


def with_editions(body: str) -> str:
    return f"WITH {EDITIONS_SQL} {body}"


def with_groups(body: str) -> str:
    return f"WITH RECURSIVE {GROUPED_SQL} {body}"


def with_catalog(body: str) -> str:
    return f"WITH RECURSIVE {CATALOG_SQL} {body}"
