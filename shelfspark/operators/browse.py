"""The read layer: facets, shelves, indexes, detail pages, dashboards, audits. Every order ends in a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import params, text
from shelfspark.operators import search

SHELF, PREVIEW, SITEMAP_PAGE, MIN_TITLES = 300, 120, 45_000, 2
#: Values that pollute the language field.
NOT_LANGUAGES = ("Fictie", "Non-fictie", "Nonfictie")


def facets(works: DataFrame, genres: DataFrame, publishers: DataFrame, authors: DataFrame, lists: DataFrame) -> dict[str, DataFrame]:
    """Values of the filter panel, most used first."""
    flags = works.agg(F.max("has_audiobook").alias("audiobook"), F.max("has_ebook").alias("ebook"))
    formats = flags.select(F.explode(F.filter(F.array(F.when(F.col("audiobook") == 1, "audiobook"), F.when(F.col("ebook") == 1, "ebook")), lambda x: x.isNotNull())).alias("format"))
    fine = works.where(F.col("language").isNotNull() & (F.length("language") <= 24) & ~F.col("language").isin(*NOT_LANGUAGES))
    return {
        "formats": formats,
        "languages": fine.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(25),
        "genres": genres.where("n_works > 0").orderBy(F.desc("n_works"), "name").limit(40),
        "publishers": publishers.orderBy(F.desc("n"), "name").limit(80),
        "authors": authors.where("n_works > 0").orderBy(F.desc("n_works"), "name").limit(120),
        "lists": lists.select("slug", "name").orderBy("name", "slug"),
    }


def slice_summary(works: DataFrame) -> DataFrame:
    """Formats and year span of a filtered slice, in one pass; sums of nothing are 0."""
    return works.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("has_ebook", "ebooks"), ("has_audiobook", "audiobooks"), ("ereader", "ereader"))],
        F.min(F.nullif("year", F.lit(0))).alias("year_min"),
        F.max("year").alias("year_max"),
    )


def top_authors(works: DataFrame, work_authors: DataFrame, authors: DataFrame, n: int = 8) -> DataFrame:
    """Authors of a slice with most of its titles."""
    counted = work_authors.join(works.select("work_id"), "work_id", "left_semi").groupBy("author_key").agg(F.count(F.lit(1)).alias("titles"))
    return counted.join(authors.select("author_key", "name", "name_fold"), "author_key").orderBy(F.desc("titles"), "name_fold", "name").limit(n).select("name", "titles")


def author_shelf(works: DataFrame, work_authors: DataFrame, author_key: str) -> DataFrame:
    """Books by a person: newest first, then by title."""
    mine = work_authors.where(F.col("author_key") == author_key)
    return works.join(mine, "work_id", "left_semi").orderBy(F.desc("year"), text.nocase("title"), "work_id").limit(SHELF)


def series_shelf(works: DataFrame, slug: str) -> DataFrame:
    """Parts of a series in order."""
    return works.where(text.slugify("series") == slug).orderBy("series_no", "year", "work_id").limit(SHELF)


def series_index(series: DataFrame) -> DataFrame:
    """Series with most parts first."""
    return series.orderBy(F.desc("titles"), text.nocase("name"), "slug")


def letter_counts(authors: DataFrame, by_surname: bool = True) -> DataFrame:
    """Authors per letter, the catch-all last."""
    column = "surname_letter" if by_surname else "first_letter"
    counted = authors.where((F.col("n_works") > 0) & (F.col("first_sort") != "")).groupBy(F.col(column).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("letter") == text.OTHER_LETTER, "letter")


def authors_in_letter(authors: DataFrame, which: str, by_surname: bool = True) -> DataFrame:
    """One letter's authors in order of its sort key."""
    column, order = ("surname_letter", ("surname_sort", "first_sort")) if by_surname else ("first_letter", ("first_sort",))
    mine = authors.where((F.col(column) == which) & (F.col("n_works") > 0) & (F.col("first_sort") != ""))
    return mine.orderBy(*order, "author_key").select("name", F.col("n_works").alias("titles"))


def author_index(authors: DataFrame, by_surname: bool = True) -> DataFrame:
    """Every person with works, in hub order."""
    order = ("surname_sort", "first_sort") if by_surname else ("first_sort",)
    return authors.where("n_works > 0").orderBy(*order, "author_key").select("name", "name_fold", "surname_sort", "first_sort", F.col("n_works").alias("titles"))


def publisher_pages(publishers: DataFrame) -> DataFrame:
    """slug, name, titles of every publisher page, spellings merged."""
    merged = search.merged_publishers(publishers.where(F.col("name_fold") != ""))
    return merged.select(F.replace("name_fold", F.lit(" "), F.lit("-")).alias("slug"), "name", F.col("n").alias("titles")).orderBy("slug")


def genre_spellings(genres: DataFrame, slug: str) -> DataFrame:
    """Every spelling that folds onto a genre page."""
    return genres.where(text.fold("name") == slug.replace("-", " ")).select("name").orderBy("name")


def genre_children(pages: DataFrame, slug: str) -> DataFrame:
    """Subgenres of a page, largest first."""
    return pages.where(F.col("parent_slug") == slug).orderBy(F.desc("titles"), "slug").select("slug", "name", "titles")


def genre_tree(tree: DataFrame, pages: DataFrame, audience: str) -> DataFrame:
    """Top genres of an audience with their children nested, largest first."""
    named = tree.where(F.col("audience") == audience).join(pages.select("slug", "name"), "slug")
    kid = F.struct((-F.col("titles")).alias("less"), F.col("slug"), F.col("name"), F.col("titles"))
    kids = named.where(F.col("parent_slug") != "").groupBy(F.col("parent_slug").alias("slug")).agg(F.array_sort(F.collect_list(kid)).alias("children"))
    tops = named.where(F.col("parent_slug") == "").select("slug", "name", "titles").join(kids, "slug", "left")
    tidy = F.transform(F.coalesce("children", F.array().cast(kids.schema["children"].dataType)), lambda x: F.struct(x["slug"].alias("slug"), x["name"].alias("name"), x["titles"].alias("titles")))
    return tops.withColumn("children", tidy).orderBy(F.desc("titles"), F.lower("name"), "slug")


def work_ref(works: DataFrame, editions: DataFrame, ppn: str) -> DataFrame:
    """work_id for a work or any of its editions; no row for an unknown number."""
    direct = works.where(F.col("work_id") == ppn).select("work_id", F.lit(0).alias("p"))
    through = editions.where(F.col("ppn") == ppn).select("work_id", F.lit(1).alias("p")).join(works.select("work_id"), "work_id", "left_semi")
    return direct.unionByName(through).orderBy("p").limit(1).select("work_id")


def shown_genres(work_genres: DataFrame, works: DataFrame, parents: DataFrame) -> DataFrame:
    """work_id, genre, parent as a book page shows them: a top genre named as a parent beside it drops."""
    aud = works.select("work_id", F.lower(F.coalesce("audience", F.lit(""))).alias("audience"))
    full = work_genres.join(aud, "work_id").join(parents, ["audience", "genre"], "left").select("work_id", "genre", "parent")
    shown = full.where(F.col("parent").isNotNull()).select("work_id", F.col("parent").alias("genre"), F.lit(None).cast("string").alias("parent")).distinct()
    hidden = shown.select("work_id", "genre")
    tops = full.where(F.col("parent").isNull()).join(hidden, ["work_id", "genre"], "left_anti")
    return tops.unionByName(full.where(F.col("parent").isNotNull()))


def book_detail(ppn: str, works: DataFrame, editions: DataFrame, work_authors: DataFrame, authors: DataFrame, work_genres: DataFrame, parents: DataFrame, work_lists: DataFrame | None = None) -> DataFrame:
    """One nested row for a work id: work, editions (e-books first), authors, genres, lists; none otherwise."""
    work = works.where(F.col("work_id") == ppn)
    own = editions.where(F.col("work_id") == ppn)
    edition = F.struct(F.when(F.col("format") == "ebook", 0).otherwise(1).alias("o"), F.col("ppn"), F.col("format"), F.col("year"), F.col("publisher"))
    eds = own.groupBy("work_id").agg(F.array_sort(F.collect_list(edition)).alias("editions"))
    names = work_authors.where(F.col("work_id") == ppn).join(authors.select("author_key", "name"), "author_key").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("authors"))
    tagged = shown_genres(work_genres.where(F.col("work_id") == ppn), work, parents).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("parent", "genre").alias("o"), F.col("genre"), F.col("parent")))).alias("genres"))
    out = work.join(eds, "work_id", "left").join(names, "work_id", "left").join(tagged, "work_id", "left")
    if work_lists is not None:
        held = work_lists.where(F.col("work_id") == ppn).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "slug"))).alias("lists"))
        out = out.join(held, "work_id", "left")
    return out


def leading_editions(editions: DataFrame) -> DataFrame:
    """The first edition of each format of a work."""
    return editions.groupBy("work_id", "format").agg(F.min("ppn").alias("ppn"))


def lists_overview(lists: DataFrame, items: DataFrame, sort: str = "name") -> DataFrame:
    """total and available slots of each list, empty lists too."""
    counted = lists.join(items.select(F.col("list").alias("slug"), "work_id", F.lit(1).alias("__slot")), "slug", "left").groupBy("slug", "name").agg(F.count("__slot").alias("total"), F.sum(F.when(F.col("work_id").isNotNull(), 1).otherwise(0)).alias("available"))
    share = F.when(F.col("total") > 0, F.col("available") / F.col("total")).otherwise(0.0)
    first = {"available": [F.desc("available")], "total": [F.desc("total")], "pct": [share.desc()]}.get(sort, [])
    return counted.orderBy(*first, text.nocase("name"), "slug")


def list_contents(items: DataFrame, works: DataFrame, show: str = "all") -> DataFrame:
    """Slots in order with their works; show: all, available or unavailable."""
    out = items.join(works.select("work_id", "has_ebook", "has_audiobook"), "work_id", "left")
    keep = {"available": F.col("work_id").isNotNull(), "unavailable": F.col("work_id").isNull()}.get(show, F.lit(True))
    return out.where(keep).orderBy("list", "position")


def lists_of(works_page: DataFrame, work_lists: DataFrame) -> DataFrame:
    """work_id, lists: what each book of a page is on, by position."""
    held = work_lists.join(works_page.select("work_id"), "work_id", "left_semi")
    return held.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "slug"))).alias("lists"))


def author_lists(works: DataFrame, work_lists: DataFrame, lists: DataFrame) -> DataFrame:
    """slug, name, year of every list that a shelf's books are on, each once, newest year first."""
    held = work_lists.join(works.select("work_id"), "work_id", "left_semi").groupBy("slug").agg(F.max("year").alias("year"))
    return held.join(lists.select("slug", "name"), "slug").orderBy(F.col("year").desc_nulls_last(), "slug").select("slug", "name", "year")


def audiences(tree: DataFrame) -> DataFrame:
    """Audiences that have a genre at all."""
    return tree.select("audience").distinct().orderBy(F.desc("audience"))


def browse_paths(authors: DataFrame, series: DataFrame, genre_pages: DataFrame, publisher_pages_: DataFrame) -> DataFrame:
    """Paths of the browse sitemap: hubs, letters, and every page that gathers enough titles."""
    spark = authors.sparkSession
    hubs = spark.createDataFrame([(x,) for x in ("/auteurs", "/genres", "/e-books", "/luisterboeken")], "path string")
    under = lambda root, df, slug: df.select(F.concat(F.lit(f"/{root}/"), slug).alias("path"))
    letters = under("auteurs", letter_counts(authors), F.lower("letter"))
    people = under("auteur", indexable(authors.where(F.col("first_sort") != "").withColumnRenamed("n_works", "titles")), F.col("first_sort"))
    rest = [under(root, indexable(df), F.col("slug")) for root, df in (("reeks", series), ("genre", genre_pages), ("uitgever", publisher_pages_))]
    out = hubs.unionByName(letters).unionByName(people)
    for df in rest:
        out = out.unionByName(df)
    return out


def dashboard_counts(works: DataFrame, editions: DataFrame, authors: DataFrame, publishers: DataFrame) -> DataFrame:
    """Catalog totals at both grains, one row."""
    one = lambda df, *aggs: df.agg(*aggs)
    total = F.count(F.lit(1))
    w = one(works, total.alias("total"), *[F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("has_ebook", "ebooks"), ("has_audiobook", "audiobooks"), ("ereader", "ereader"))], F.countDistinct("language").alias("languages"))
    parts = [one(editions, total.alias("editions")), one(authors, total.alias("authors")), one(publishers, F.countDistinct("name_fold").alias("publishers"))]
    for p in parts:
        w = w.crossJoin(F.broadcast(p))  # one row each
    return w


def year_histogram(works: DataFrame) -> DataFrame:
    """Works per year from 2000 on."""
    return works.where("year >= 2000").groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def group_sizes(works: DataFrame) -> DataFrame:
    """How many works have how many editions."""
    return works.groupBy("n_editions").agg(F.count(F.lit(1)).alias("n")).orderBy("n_editions")


def false_splits(editions: DataFrame, works: DataFrame) -> DataFrame:
    """Editions whose label names the other format while the work lacks it."""
    label = F.lower("also_available_as")
    joined = editions.join(works.select("work_id", "has_ebook", "has_audiobook"), "work_id")
    missing = (label.contains("luisterboek") & (F.col("has_audiobook") == 0)) | (label.contains("e-book") & (F.col("has_ebook") == 0))
    return joined.where(missing).orderBy("ppn").select("ppn", "title")


def suspicious_merges(editions: DataFrame) -> DataFrame:
    """Works whose editions disagree on language, publisher, or by more than five years."""
    grouped = editions.groupBy("work_id").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("langs"), (F.max("year") - F.min(F.nullif("year", F.lit(0)))).alias("span"), F.countDistinct(F.when(F.col("publisher").isNotNull(), text.publisher_key("publisher")).otherwise("")).alias("pubs"))
    return grouped.where("n > 1 AND (langs > 1 OR span > 5 OR pubs > 1)").orderBy(F.desc("langs"), F.desc("span"), "work_id")


def sample(df: DataFrame, n: int = 20) -> tuple[list, int]:
    """The first rows of an audit and how many more there are."""
    return df.limit(n).collect(), max(0, df.count() - n)


def sitemap_pages(works: DataFrame, size: int = SITEMAP_PAGE) -> DataFrame:
    """work_id, page: pages of a fixed size in order of id.

    Ids are ranked in ranges: one count a range is summed on the way, so no task ranks all ids.
    """
    ranged = works.select("work_id").repartitionByRange("work_id").withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("work_id"))
    return ranged.withColumn("rank", rank).join(F.broadcast(before), "part").select("work_id", (F.floor((F.col("before") + F.col("rank") - 1) / size) + 1).alias("page"))


def indexable(pages: DataFrame) -> DataFrame:
    """Pages that gather enough titles to be nominated to search engines."""
    return pages.where(F.col("titles") >= MIN_TITLES)


def landing(works: DataFrame, f: params.SearchFilters, **links: DataFrame) -> DataFrame:
    """The preview of a browse page."""
    return params.ordered(params.filtered(works, f, **links), f.sort).limit(PREVIEW)
