"""The batch build: raw records to the published tables of the catalog.

All tables are DataFrames over one grouped edition table; links use natural keys (names, folds and
slugs), so nothing needs a numbered surrogate. Every vote has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.functions import text
from shelfspark.plans import grouping

AUDIENCES = ("volwassenen", "jeugd")  # the first is where records without an audience go


def majority(df: DataFrame, keys: list[str], value: str, *ties: Column, alias: str | None = None) -> DataFrame:
    """The most frequent value for each key; ties by the orders given, then the least value."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = W.partitionBy(*keys).orderBy(F.desc("__n"), *ties, F.asc(value))
    return counted.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*keys, F.col(value).alias(alias or value))


def publisher_canon(records: DataFrame) -> DataFrame:
    """pub_key, canon: each publisher's most frequent spelling, ties to the one seen first by ppn."""
    spelled = records.where(F.coalesce(F.col("publisher"), F.lit("")) != "").select(text.publisher_key("publisher").alias("pub_key"), "publisher", "ppn")
    counted = spelled.groupBy("pub_key", "publisher").agg(F.count(F.lit(1)).alias("n"), F.min("ppn").alias("first"))
    best = F.row_number().over(W.partitionBy("pub_key").orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", best).where("r = 1").select("pub_key", F.col("publisher").alias("canon"))


def transform(records: DataFrame, ereader: DataFrame | None = None, ereader_stamp: str = "", prior: DataFrame | None = None, genres: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """Live records, enriched: authors, language, publisher, series, e-reader flag, subjects, recency.

    ereader: ppn of e-books known to work on an e-reader, true of records first seen by
    ereader_stamp. prior: ppn, flag from the last build, used only without ereader. genres: ppn,
    names. recent: ppn, rank. Columns that records lack are taken as null.
    """
    have = set(records.columns)
    for name, kind in (("removed_at", "string"), ("first_seen", "string"), ("ereader", "int"), ("series", "string"), ("series_no", "int"), ("note", "string"), ("subjects", "array<string>"), ("added_rank", "int")):
        if name not in have:
            records = records.withColumn(name, F.lit(None).cast(kind))
    live = records.where(F.col("ppn").isNotNull() & F.col("removed_at").isNull())
    split = F.array_distinct(F.filter(F.transform(text.split_authors("author"), text.canonical_author), lambda x: F.coalesce(x, F.lit("")) != ""))
    out = live.withColumn("authors", split).withColumn("author", F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(F.col("author")))
    out = out.withColumn("language", text.valid_language("language"))
    canon = publisher_canon(live)
    out = out.withColumn("pub_key", text.publisher_key("publisher")).join(canon, "pub_key", "left")
    out = out.withColumn("publisher", text.canonical_publisher("publisher", F.col("canon"))).drop("pub_key", "canon")
    in_title, in_note = text.detect_series("title"), text.detect_series("note")
    sniffed = F.when(in_title["series"].isNotNull(), in_title).otherwise(in_note)
    bare = F.coalesce(F.col("series"), F.lit("")) == ""
    out = out.withColumn("__sniffed", sniffed)
    out = out.withColumn("series_no", F.when(bare & F.col("__sniffed.series").isNotNull(), F.col("__sniffed.series_no")).otherwise(F.col("series_no")))
    out = out.withColumn("series", F.when(bare & F.col("__sniffed.series").isNotNull(), F.col("__sniffed.series")).otherwise(F.col("series"))).drop("__sniffed")
    open_flag = (F.col("format") == "ebook") & F.col("ereader").isNull()
    if ereader is not None:
        out = out.join(ereader.select("ppn", F.lit(1).alias("__in")).distinct(), "ppn", "left")
        told = F.when(F.col("__in") == 1, 1).when(F.coalesce("first_seen", F.lit("")) <= ereader_stamp, 0)
        out = out.withColumn("ereader", F.when(open_flag, told).otherwise(F.col("ereader"))).drop("__in")
    elif prior is not None:
        out = out.join(prior.select("ppn", F.col("ereader").alias("__prior")), "ppn", "left")
        out = out.withColumn("ereader", F.when(open_flag, F.col("__prior")).otherwise(F.col("ereader"))).drop("__prior")
    if genres is not None:
        out = out.join(genres.select("ppn", F.col("names").alias("__names")), "ppn", "left")
        out = out.withColumn("subjects", F.when(F.col("__names").isNull(), F.col("subjects")).otherwise(F.array_distinct(F.concat(F.coalesce("subjects", F.array().cast("array<string>")), "__names")))).drop("__names")
    if recent is not None:
        out = out.join(recent.select("ppn", F.col("rank").alias("__rank")), "ppn", "left").withColumn("added_rank", F.coalesce("__rank", "added_rank")).drop("__rank")
    return out


def works(editions: DataFrame) -> DataFrame:
    """One row a book from editions with work_id: the representative's facts, pooled ones, flags and counts.

    The self-join meets one row per work: the group is aggregated first. The longest summary is a
    maximum over (length, least ppn), so no window sorts a work's editions.
    """
    pooled = ("language", "series", "series_no", "audience", "keywords")
    blurb = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.struct((-F.length("summary")).alias("n"), F.col("ppn").alias("ppn"), F.col("summary").alias("text")))
    of = lambda kind: F.when(F.col("format") == kind, F.col("ppn"))
    grouped = editions.groupBy("work_id").agg(
        F.min(blurb)["text"].alias("summary"),
        F.min(F.nullif("year", F.lit(0))).alias("year"),
        *[F.max(c).alias(f"__{c}") for c in pooled],
        F.max((F.col("format") == "ebook").cast("int")).alias("has_ebook"),
        F.max((F.col("format") == "audiobook").cast("int")).alias("has_audiobook"),
        F.max(F.when(F.col("format") == "ebook", F.col("ereader"))).alias("ereader"),
        F.min(of("ebook")).alias("ebook_ppn"),
        F.min(of("audiobook")).alias("audiobook_ppn"),
        F.count(F.lit(1)).alias("n_editions"),
        F.min("added_rank").alias("added_rank"),
    )
    rep = editions.where(F.col("ppn") == F.col("work_id")).select("work_id", "title", "author", "publisher", *pooled)
    merged = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in pooled]
    return grouped.join(rep, "work_id").select("work_id", "title", "author", "summary", "publisher", "year", *merged, "has_ebook", "has_audiobook", "ereader", "ebook_ppn", "audiobook_ppn", "n_editions", "added_rank")


def work_genres(editions: DataFrame) -> DataFrame:
    """work_id, genre: each once."""
    return editions.select("work_id", F.explode("subjects").alias("genre")).where(F.col("genre") != "").distinct()


def work_authors(editions: DataFrame) -> DataFrame:
    """work_id, author_key, position: each person once a work, at the first edition's position by ppn."""
    named = editions.select("work_id", "ppn", F.posexplode("authors").alias("position", "name"))
    keyed = named.withColumn("author_key", text.author_key("name"))
    return keyed.groupBy("work_id", "author_key").agg(F.min_by("position", F.struct("ppn", "position")).alias("position"))


def authors(editions: DataFrame, links: DataFrame) -> DataFrame:
    """One row a person: most frequent spelling (ties to the least), fold, sort keys, letters, n_works."""
    spelled = editions.select(F.explode("authors").alias("name")).withColumn("author_key", text.author_key("name"))
    best = majority(spelled, ["author_key"], "name")
    counts = links.groupBy("author_key").agg(F.count(F.lit(1)).alias("n_works"))
    out = best.join(counts, "author_key", "left").withColumn("surname_sort", text.surname_key("name")).withColumn("first_sort", text.slugify("name"))
    return out.select("author_key", "name", text.fold("name").alias("name_fold"), "surname_sort", "first_sort", text.letter("surname_sort").alias("surname_letter"), text.letter("first_sort").alias("first_letter"), F.coalesce("n_works", F.lit(0)).alias("n_works"))


def genres(links: DataFrame) -> DataFrame:
    """name, n_works."""
    return links.groupBy(F.col("genre").alias("name")).agg(F.count(F.lit(1)).alias("n_works"))


def value_counts(editions: DataFrame, field: str) -> DataFrame:
    """name, name_fold, n of a field over representatives only: books, not files."""
    held = editions.where((F.col("ppn") == F.col("work_id")) & (F.coalesce(F.col(field), F.lit("")) != ""))
    return held.groupBy(F.col(field).alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", text.fold("name").alias("name_fold"), "n")


def series_pages(all_works: DataFrame) -> DataFrame:
    """slug, name, titles: spellings merged by slug, the most frequent one shown."""
    named = all_works.where(F.coalesce(F.col("series"), F.lit("")) != "").select(text.slugify("series").alias("slug"), "series").where(F.col("slug") != "")
    return majority(named, ["slug"], "series", alias="name").join(named.groupBy("slug").agg(F.count(F.lit(1)).alias("titles")), "slug")


def pooled_text(editions: DataFrame, genre_links: DataFrame) -> DataFrame:
    """The searchable text of each work, pooled over its editions: title, author, subjects, summary."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    pooled = editions.groupBy("work_id").agg(joined("title").alias("title"), joined("author").alias("author"), joined("keywords").alias("keywords"), joined("summary").alias("summary"))
    tagged = genre_links.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("genre")), " ").alias("genres"))
    out = pooled.join(tagged, "work_id", "left")
    return out.select("work_id", "title", "author", F.concat(F.coalesce("genres", F.lit("")), F.lit(" "), F.coalesce("keywords", F.lit(""))).alias("subjects"), "summary")


def text_pieces(editions: DataFrame, genre_links: DataFrame) -> DataFrame:
    """The searchable text of each work in pieces: columns as in pooled_text, but a row for each different value of a field.

    A row holds one value and null elsewhere, so a work of very many editions is never one text. A
    work without any text has a row too.
    """
    kinds = {"title": "title", "author": "author", "keywords": "subjects", "summary": "summary"}
    piece = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))
    held = editions.select("work_id", F.inline(F.array(*[piece(c, c) for c in kinds]))).where("value IS NOT NULL OR kind = 'title'")
    rows = held.distinct().unionByName(genre_links.select("work_id", F.lit("genre").alias("kind"), F.col("genre").alias("value")).distinct())
    field = lambda c: F.when(F.col("kind").isin(*[k for k, f in (kinds | {"genre": "subjects"}).items() if f == c]), F.col("value"))
    return rows.select("work_id", *[field(c).alias(c) for c in ("title", "author", "subjects", "summary")])


def work_slugs(all_works: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """work_id, slug, from the title and the first author's display name."""
    first = links.groupBy("work_id").agg(F.min_by("author_key", F.struct("position", "author_key")).alias("author_key")).join(people.select("author_key", "name"), "author_key")
    return all_works.select("work_id", "title").join(first, "work_id", "left").select("work_id", text.work_slug("title", "name").alias("slug"))


def genre_parents(records: DataFrame) -> DataFrame:
    """audience, genre, parent: the most common name at a code's major.0 within the audience, if not the genre itself.

    records: ppn, audience and genres, an array of (code, name). A genre's code is the first seen by ppn.
    """
    tagged = records.select(F.lower(F.trim(F.coalesce("audience", F.lit("")))).alias("audience"), "ppn", F.posexplode("genres").alias("at", "g"))
    named = tagged.where((F.coalesce(F.col("g.name"), F.lit("")) != "") & (F.coalesce(F.col("g.code"), F.lit("")) != ""))
    coded = named.groupBy("audience", F.col("g.name").alias("genre")).agg(F.min_by(F.col("g.code"), F.struct("ppn", "at")).alias("code"), F.count(F.lit(1)).alias("n"))
    top = coded.withColumn("r", F.row_number().over(W.partitionBy("audience", "code").orderBy(F.desc("n"), "genre"))).where("r = 1").select("audience", F.col("code").alias("top_code"), F.col("genre").alias("parent"))
    minor = coded.where(~F.coalesce(F.split("code", r"\.")[1], F.lit("")).isin("", "0"))
    wanted = minor.withColumn("top_code", F.concat(F.split("code", r"\.")[0], F.lit(".0")))
    return wanted.join(top, ["audience", "top_code"]).where(F.col("parent") != F.col("genre")).select("audience", "genre", "parent")


def genre_taxonomy(links: DataFrame, parents: DataFrame, all_works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """genre_pages (slug, name, titles, parent_slug) and genre_tree (audience, slug, parent_slug, titles).

    The catalog-wide vote counts links without a parent as votes for none; an audience's own vote
    only looks at parents named in it and present in it. Ties go to the least slug.
    """
    aud = all_works.select("work_id", F.lower(F.coalesce("audience", F.lit(""))).alias("audience"))
    rows = links.join(aud, "work_id").join(parents.select("audience", "genre", "parent"), ["audience", "genre"], "left")
    rows = rows.select("work_id", "genre", text.slugify("genre").alias("slug"), text.slugify("parent").alias("pslug"), F.when(F.col("audience").isin(*AUDIENCES), F.col("audience")).otherwise(AUDIENCES[0]).alias("audience")).where(F.col("slug") != "")
    names = rows.groupBy("slug").agg(F.min(F.struct((-F.length("genre")).alias("n"), F.col("genre").alias("name")))["name"].alias("name"), F.countDistinct("work_id").alias("titles"))
    voted = majority(rows, ["slug"], "pslug", alias="parent")
    pages = names.join(voted, "slug").select("slug", "name", "titles", F.when(F.col("parent") != F.col("slug"), F.col("parent")).otherwise("").alias("parent_slug"))
    per = rows.groupBy("audience", "slug").agg(F.countDistinct("work_id").alias("titles"))
    present = per.select("audience", F.col("slug").alias("pslug"))
    named = rows.where((F.col("pslug") != "") & (F.col("pslug") != F.col("slug"))).join(present, ["audience", "pslug"], "left_semi")
    best = majority(named, ["audience", "slug"], "pslug", alias="parent_slug")
    tree = per.join(best, ["audience", "slug"], "left").select("audience", "slug", F.coalesce("parent_slug", F.lit("")).alias("parent_slug"), "titles")
    return pages, tree


def match_lists(items: DataFrame, records: DataFrame, work_of: DataFrame) -> DataFrame:
    """List items with work_id: by ISBN digits, else by title and author key; one slot a work and list.

    items: list, position, title, author, isbn. Of slots that reach one work the first by position
    keeps it; the others stay in the list without a work.
    """
    by_isbn = records.where(text.isbn_digits("isbn") != "").groupBy(text.isbn_digits("isbn").alias("isbn_key")).agg(F.min("ppn").alias("isbn_ppn"))
    people = F.when(F.size(text.split_authors("author")) > 0, text.split_authors("author")).otherwise(F.array("author"))
    spelled = records.select("ppn", "title", F.explode(people).alias("one"))
    by_key = spelled.groupBy(text.match_key("title", text.canonical_author("one")).alias("title_key")).agg(F.min("ppn").alias("key_ppn"))
    keyed = items.withColumn("isbn_key", F.nullif(text.isbn_digits("isbn"), F.lit(""))).withColumn("title_key", text.match_key("title", "author"))
    found = keyed.join(by_isbn, "isbn_key", "left").join(by_key, "title_key", "left").withColumn("ppn", F.coalesce("isbn_ppn", "key_ppn"))
    found = found.join(work_of, "ppn", "left").drop("isbn_key", "title_key", "isbn_ppn", "key_ppn", "ppn")
    slot = F.row_number().over(W.partitionBy("list", "work_id").orderBy("position"))
    return found.withColumn("work_id", F.when(slot == 1, F.col("work_id")))


DERIVED = ("editions", "works", "work_genres", "work_authors", "authors", "genres", "publishers", "languages", "series", "works_fts", "slugs")


def derive(editions: DataFrame) -> dict[str, DataFrame]:
    """The tables that follow from grouped editions."""
    all_works, glinks, alinks = works(editions), work_genres(editions), work_authors(editions)
    people = authors(editions, alinks)
    tables = (editions, all_works, glinks, alinks, people, genres(glinks), value_counts(editions, "publisher"), value_counts(editions, "language"), series_pages(all_works), pooled_text(editions, glinks), work_slugs(all_works, alinks, people))
    return dict(zip(DERIVED, tables, strict=True))


def build(records: DataFrame, merges: DataFrame | None = None, splits: DataFrame | None = None, **side) -> dict[str, DataFrame]:
    """All tables from raw records. Grouping sees validated languages and the authors as catalogued."""
    live = records.where(F.col("ppn").isNotNull()) if "removed_at" not in records.columns else records.where(F.col("ppn").isNotNull() & F.col("removed_at").isNull())
    if "related_ppns" not in live.columns:
        live = live.withColumn("related_ppns", F.lit(None).cast("array<string>"))
    work_of = grouping.group_editions(live.withColumn("language", text.valid_language("language")), merges, splits)
    editions = transform(records, **side).join(work_of, "ppn")
    out = derive(editions)
    if "genres" in records.columns:
        parents = genre_parents(live)
        out["genre_parents"] = parents
        out["genre_pages"], out["genre_tree"] = genre_taxonomy(out["work_genres"], parents, out["works"])
    return out


KEPT_VERSIONS = 2


def _subfolders(spark, folder: str) -> list[str]:
    """Names of the folders in a folder, none if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


def _complete(spark, path: str) -> bool:
    """Whether a write to path was committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def pointers(spark, folder: str) -> list[int]:
    """Numbers of the complete pointers of a folder, the newest first."""
    numbers = [int(n.removeprefix("n=")) for n in _subfolders(spark, f"{folder}/CURRENT") if n.startswith("n=")]
    return sorted((n for n in numbers if _complete(spark, f"{folder}/CURRENT/n={n}")), reverse=True)


def publish(tables: dict[str, DataFrame], folder: str, version: str, keep: int = KEPT_VERSIONS) -> str:
    """Write all tables as one version, then a pointer to it; the last `keep` versions stay.

    A pointer is a folder with a number of its own, and the newest complete one counts, so nothing is
    overwritten: a run that ends at any step leaves the last version as it was, and its own leftovers
    go with the next clean-up. A version that is written again is written beside its old files.
    """
    spark = next(iter(tables.values())).sparkSession
    if not _subfolders(spark, folder):  # says that there is no version yet, so that a lost pointer is told from a first run that ended early
        spark.createDataFrame([("",)], "version string").coalesce(1).write.json(f"{folder}/CURRENT/n=0")
    known = pointers(spark, folder)
    number = max([0, *(int(n.removeprefix("n=")) for n in _subfolders(spark, f"{folder}/CURRENT") if n.startswith("n="))]) + 1
    place = f"{version}-{number}" if version in _subfolders(spark, folder) else version
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{place}/{name}")
    spark.createDataFrame([(place,)], "version string").coalesce(1).write.json(f"{folder}/CURRENT/n={number}")
    stay = [number, *known[: max(0, keep - 1)]]
    places = {_place(spark, folder, n) for n in stay}
    for n in (int(x.removeprefix("n=")) for x in _subfolders(spark, f"{folder}/CURRENT") if x.startswith("n=")):
        if n not in stay:
            workspace.remove(spark, f"{folder}/CURRENT/n={n}")
    for old in _subfolders(spark, folder):
        if old != "CURRENT" and old not in places:
            workspace.remove(spark, f"{folder}/{old}")
    return f"{folder}/{place}"


def _place(spark, folder: str, number: int) -> str:
    return spark.read.schema("version string").json(f"{folder}/CURRENT/n={number}").first()[0] or ""


def read_published(spark, folder: str, name: str) -> DataFrame:
    """A table of the current version. LookupError if nothing has been published, OSError if versions are there but no pointer."""
    known = pointers(spark, folder)
    if not known:
        if _subfolders(spark, folder):
            raise OSError(f"{folder} holds versions but no complete pointer")
        raise LookupError(f"nothing published in {folder}")
    place = _place(spark, folder, known[0])
    if not place:
        raise LookupError(f"nothing published in {folder}")
    return spark.read.parquet(f"{folder}/{place}/{name}")
