"""Curated lists: bestseller cards, API overviews, prize pages in wiki markup."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import display

ITEM = "position int, title string, author string, isbn string, cover_url string"
OVERVIEW = "struct<results:struct<lists:array<struct<list_id:string,list_name:string,list_name_encoded:string,display_name:string,books:array<struct<rank:int,title:string,author:string,primary_isbn13:string,primary_isbn10:string,book_image:string>>>>>>"
ITALIC, LINK = r"''+([^']{2,140}?)''+", r"\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]"
NOMINEES, PROSE = "(?i)genomineerd|nominat|shortlist|longlist|voordracht", "(?i)trivia|externe|zie ook|referenti|bronnen|voetnot"


def safe_slug(c: Column | str) -> Column:
    """A list's slug in lower-case letters, digits and dashes only."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9-]", "")


def bestseller_cards(pages: DataFrame, key: str = "list", html: str = "html") -> DataFrame:
    """list and ITEM fields of every card of a page; one a position, or a title and author where there is none."""
    card = F.col("card")
    cut = pages.select(key, F.posexplode(F.split(html, "card__position")).alias("nr", "card")).where("nr > 0")
    group = lambda p: F.nullif(F.regexp_extract(card, p, 1), F.lit(""))
    clean = lambda c: F.trim(unescape(c))
    fields = cut.select(
        F.col(key).alias("list"),
        "nr",
        group(r">\s*(\d+)\s*<").try_cast("int").alias("position"),
        clean(F.coalesce(group(r'card__title[^>]*\btitle="([^"]+)"'), group(r"card__title[^>]*>\s*([^<]+?)\s*<"))).alias("title"),
        clean(group(r"(?s)card__author.*?<a[^>]*>\s*([^<]+?)\s*</a>")).alias("author"),
        group(r"ISBN\s*(97[89]\d{10})").alias("isbn"),
        group(r'src="(https://[^"]+/covers/[^"]+)"').alias("cover_url"),
    ).where(F.col("title").isNotNull())
    same = F.coalesce(F.col("position").cast("string"), F.to_json(F.struct("title", "author")))
    first = F.row_number().over(W.partitionBy("list", same).orderBy("nr"))
    return fields.withColumn("r", first).where("r = 1").orderBy("list", F.coalesce("position", F.lit(999)), "nr").select("list", "position", "title", "author", "isbn", "cover_url")


def unescape(c: Column) -> Column:
    """The common character references decoded; & last."""
    out = F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&#x27;"), F.lit("'"))
    for name in ("eacute", "euml", "iuml", "ouml", "uuml", "egrave", "agrave", "ccedil", "nbsp"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(html_lib.unescape(f"&{name};")))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def week_range(page: Column | str) -> Column:
    """The week that a page names, `Week 26 - 2026` or `2026 week 27`, with its days in Dutch; null without one."""
    c = F.col(page) if isinstance(page, str) else page
    a, b = r"(?i)week\s*(\d{1,2})\s*[-–]\s*(20\d\d)", r"(?i)(20\d\d)\s*week\s*(\d{1,2})\b"
    num = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    week, year = F.when(c.rlike(a), num(a, 1)).otherwise(num(b, 2)), F.when(c.rlike(a), num(a, 2)).otherwise(num(b, 1))
    monday = F.date_add(F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)))), 7 * (week - 1))
    sunday = F.date_add(monday, 6)
    valid = (week >= 1) & (F.extract(F.lit("YEAROFWEEK"), monday) == year) & (F.weekofyear(monday) == week)
    month = lambda d: display.month_name(F.month(d))
    day = lambda d: F.dayofmonth(d).cast("string")
    start = F.when(F.month(monday) == F.month(sunday), day(monday)).when(F.year(monday) == F.year(sunday), F.concat_ws(" ", day(monday), month(monday))).otherwise(F.concat_ws(" ", day(monday), month(monday), F.year(monday)))
    said = F.concat(F.lit("week "), week, F.lit(" · "), start, F.lit(" t/m "), F.concat_ws(" ", day(sunday), month(sunday), F.year(sunday)))
    return F.when(valid, said)


def title_case(c: Column) -> Column:
    """Titles all in capitals with every run of letters capitalised; others as they are."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    cased = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")
    return F.when((F.upper(c) == c) & (F.lower(c) != c), cased).otherwise(c)


def api_overview(documents: DataFrame, column: str = "json") -> DataFrame:
    """list, name and ITEM fields of an API's lists of books; lists without books give none."""
    lists = documents.select(F.explode(F.from_json(column, OVERVIEW)["results"]["lists"]).alias("l"))
    code = F.coalesce(F.nullif(F.col("l.list_name_encoded"), F.lit("")), F.col("l.list_id"))
    name = F.coalesce(F.nullif(F.col("l.display_name"), F.lit("")), F.nullif(F.col("l.list_name"), F.lit("")), code)
    books = lists.select(F.concat(F.lit("nyt-"), code).alias("list"), F.concat(F.lit("NYT — "), name).alias("name"), F.explode("l.books").alias("b"))
    isbn = F.coalesce(F.nullif(F.col("b.primary_isbn13"), F.lit("")), F.col("b.primary_isbn10"))
    return books.select("list", "name", F.col("b.rank").alias("position"), title_case(F.col("b.title")).alias("title"), F.col("b.author").alias("author"), isbn.alias("isbn"), F.col("b.book_image").alias("cover_url"))


def prize_pages(pages: DataFrame, key: str = "list", markup: str = "wikitext") -> DataFrame:
    """list, position, year, title, author, won: entries of a prize page, newest year first.

    A line's year and section are the last ones named before it in the page; a number in a title or
    an author's name is no year. The first entry of a year outside a section of nominees has won; a
    heading that names the year again begins another such round. Windows run within a page.
    """
    stripped = F.trim(F.regexp_replace(F.col("raw"), r"[\t\r]", " "))
    lines = pages.select(F.col(key).alias("list"), F.posexplode(F.split(markup, r"\r?\n")).alias("nr", "raw")).withColumn("line", stripped)
    order = W.partitionBy("list").orderBy("nr")
    heading, marked = F.col("line").startswith("="), F.col("line").rlike("^[=*|]")
    italic = F.regexp_extract("line", ITALIC, 1)
    linked = lambda c: F.regexp_replace(c, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    clean = lambda c: F.btrim(F.regexp_replace(linked(c), r"\([^)]*\)$", ""), F.lit(" '\""))
    lines = lines.withColumn("title", clean(italic)).withColumn("whole", F.trim(linked(italic)))
    name = lambda link: F.trim(F.regexp_extract(link, LINK, 1))
    person = lambda a: ~a.rlike(r"^\d{3,4}$") & (clean(a) != F.col("title")) & (a != F.col("whole"))
    lines = lines.withColumn("link", F.try_element_at(F.filter(F.regexp_extract_all("line", F.lit(LINK), F.lit(0)), lambda x: person(name(x))), F.lit(1)))
    beside = F.replace(F.replace(F.col("line"), F.regexp_extract("line", ITALIC, 0), F.lit(" ")), F.coalesce("link", F.lit("")), F.lit(" "))
    dated = F.when((italic != "") & F.col("line").rlike(r"^[*|]"), beside).otherwise(F.col("line"))
    year = F.nullif(F.regexp_extract(dated, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).try_cast("int")
    lines = lines.withColumn("nominees", F.last(F.when(heading, F.col("line").rlike(NOMINEES)), True).over(order))
    lines = lines.withColumn("prose", F.coalesce(F.last(F.when(heading, F.col("line").rlike(PROSE)), True).over(order), F.lit(False)))
    lines = lines.where(~F.col("prose")).withColumn("named", F.when(marked, year)).withColumn("year", F.last("named", True).over(order))
    again = heading & F.col("named").isNotNull() & ~F.col("line").rlike(NOMINEES)
    lines = lines.withColumn("block", F.sum((~F.col("year").eqNullSafe(F.lag("year").over(order)) | again).cast("int")).over(order))
    entries = lines.where(F.col("line").rlike(r"^[*|]") & (italic != "")).withColumn("author", name(F.col("link")))
    entries = entries.where((F.col("title") != "") & F.col("author").isNotNull() & (F.lower("title") != F.lower("author")))
    seen = F.row_number().over(W.partitionBy("list", F.lower("title"), F.lower("author")).orderBy("nr"))
    entries = entries.withColumn("seen", seen).where("seen = 1")
    open_ = ~F.coalesce("nominees", F.lit(False))
    first = F.min(F.when(open_, F.col("nr"))).over(W.partitionBy("list", "block"))
    entries = entries.withColumn("won", (open_ & (F.col("nr") == first)).cast("int"))
    place = F.row_number().over(W.partitionBy("list").orderBy(F.desc(F.coalesce("year", F.lit(0))), "nr"))
    return entries.select("list", place.alias("position"), "year", "title", "author", "won")


def update(providers: dict[str, Callable[[], DataFrame]], prior: dict[str, DataFrame], least: int = 1) -> tuple[dict[str, DataFrame], list[str]]:
    """Fetch every provider; one that fails, or parses to almost nothing, keeps its last list. Gives also who kept it."""
    out, kept = dict(prior), []
    for slug, fetch in providers.items():
        try:
            fresh = fetch()
            enough = fresh.limit(least).count() >= least
        except Exception:  # any provider may fail on its own
            enough = False
        if enough:
            out[slug] = fresh
        else:
            kept.append(slug)
    return out, kept
