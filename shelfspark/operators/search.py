"""Full-text search: postings, prefix match, BM25 with field weights, suggestions.

A query word matches every token that begins with it. `postings` makes the index: a row for each token
of a document with its weight (the field weights times occurrences), in order of the token, and
`lengths` the documents' lengths. `match_index` reads only the rows of the query's prefixes, which
Parquet finds by the tokens' ranges; `match` answers without an index, in one pass over the texts. A
document may come in pieces, several rows with its key (catalog.text_pieces): what they hold is summed.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import params, text

FIELD_WEIGHTS = {"title": 10.0, "author": 6.0, "subjects": 2.0, "summary": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(c: Column | str) -> Column:
    """Lower-case tokens of letters and digits, without combining marks, as the index has them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(_unmarked(c)), F.lit(r"([\p{L}\p{N}]+)"))


def _unmarked(c: Column) -> Column:
    source, target, marks = [], [], []
    for i in range(128, 0x2000):
        x = chr(i)
        if unicodedata.combining(x):
            marks.append(x)
        elif (plain := "".join(y for y in unicodedata.normalize("NFD", x) if not unicodedata.combining(y))) != x and len(plain) == 1:
            source.append(x)
            target.append(plain)
    return F.translate(F.coalesce(c, F.lit("")), "".join(source + marks), "".join(target))


def _fields(docs: DataFrame, weights: dict[str, float]) -> list[tuple[str, float]]:
    return [(f, w) for f, w in weights.items() if f in docs.columns]


def postings(docs: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, key: str = "work_id") -> DataFrame:
    """token, key, weight, sorted by token within ranges: write it as it is, and prefixes are read by row group."""
    weighted = lambda w: lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight"))
    parts = [F.transform(tokens(f), weighted(w)) for f, w in _fields(docs, weights)]
    rows = docs.select(key, F.explode(F.concat(*parts)).alias("x")).select(key, "x.token", "x.weight")
    return rows.groupBy("token", key).agg(F.sum("weight").alias("weight")).repartitionByRange("token", key).sortWithinPartitions("token", key)


def lengths(docs: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, key: str = "work_id") -> DataFrame:
    """key, dl: tokens of every document."""
    per_row = docs.select(key, sum((F.size(tokens(f)) for f, _ in _fields(docs, weights)), F.lit(0)).alias("dl"))
    return per_row.groupBy(key).agg(F.sum("dl").alias("dl"))


def match_index(index: DataFrame, sizes: DataFrame, q: str, key: str = "work_id") -> DataFrame:
    """match() from stored postings and lengths: rows of the prefixes alone are read, and summed before they move."""
    words = params.terms(q)
    if not words:
        return index.sparkSession.createDataFrame([], f"{key} {dict(index.dtypes)[key]}, score double")
    frequency = [F.sum(F.when(F.col("token").startswith(t), F.col("weight")).otherwise(0.0)).alias(f"f{i}") for i, t in enumerate(words)]
    hits = index.where(reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in words])).groupBy(key).agg(*frequency)
    seen = hits.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(words))])
    stats = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avg")).crossJoin(seen)  # one row each
    for i in range(len(words)):
        hits = hits.where(F.col(f"f{i}") > 0)
    return _scored(hits.join(sizes, key).crossJoin(F.broadcast(stats)), len(words), key)  # one row of statistics


def _scored(hits: DataFrame, words: int, key: str) -> DataFrame:
    score = F.lit(0.0)
    for i in range(words):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.log((F.col("docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    return hits.select(key, score.alias("score"))


def match(docs: DataFrame, q: str, weights: dict[str, float] = FIELD_WEIGHTS, key: str = "work_id") -> DataFrame:
    """key, score of the documents that have all query words as prefixes; a lower score is better.

    No words in q: no rows. One pass over the documents computes each row's length and weighted
    frequency of every word inside the row, with no explode; only these numbers are summed by key, and
    the corpus statistics are one aggregate.
    """
    words = params.terms(q)
    spark = docs.sparkSession
    if not words:
        return spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, score double")
    tokenised = docs.select(key, *[tokens(f).alias(f) for f, _ in _fields(docs, weights)])
    count = lambda f, t: F.size(F.filter(F.col(f), lambda x: x.startswith(t)))
    frequency = [sum((count(f, t) * F.lit(w) for f, w in _fields(docs, weights)), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(words)]
    length = sum((F.size(f) for f, _ in _fields(docs, weights)), F.lit(0)).alias("dl")
    counted = tokenised.select(key, length, *frequency).groupBy(key).agg(F.sum("dl").alias("dl"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(words))])
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(words))])
    hits = counted
    for i in range(len(words)):
        hits = hits.where(F.col(f"f{i}") > 0)
    return _scored(hits.crossJoin(F.broadcast(stats)), len(words), key)  # one row of statistics


def count_matches(docs: DataFrame, q: str, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """How many documents match, of one row each: no join, no scores."""
    every = F.flatten(F.array(*[tokens(f) for f, _ in _fields(docs, weights)]))
    has = lambda t: F.exists(every, lambda x: x.startswith(t))
    out = docs
    for t in params.terms(q):
        out = out.where(has(t))
    return out.agg(F.count(F.lit(1)).alias("total"))


def search(works: DataFrame, texts: DataFrame, f: params.SearchFilters, number: int = 1, size: int = 24, **links: DataFrame) -> DataFrame:
    """One page of works under filters, by relevance or another order; without words relevance is title order."""
    found = params.filtered(works, f, **links)
    if params.terms(f.q):
        found = found.join(match(texts, f.q), "work_id")
        if f.sort == "relevance":
            return params.page(found.orderBy("score", "work_id"), number, size)
    return params.page(params.ordered(found, f.sort), number, size)


def containing(df: DataFrame, fold_column: Column | str, q: str) -> DataFrame:
    """Rows whose fold contains the query's fold; a query that folds to nothing matches every row."""
    c = F.col(fold_column) if isinstance(fold_column, str) else fold_column
    return df.where(F.contains(c, F.lit(text.fold_text(q))))


def merged_publishers(publishers: DataFrame) -> DataFrame:
    """name_fold, name, n: spellings of one page summed, the most used shown, ties to the longest, then the least."""
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("size"), F.col("name").alias("name")))["name"]
    return publishers.groupBy("name_fold").agg(best.alias("name"), F.sum("n").alias("n"))


def suggest(q: str, limit: int, works: DataFrame, texts: DataFrame, authors: DataFrame, publishers: DataFrame, genres: DataFrame, languages: DataFrame, lists: DataFrame) -> DataFrame | None:
    """kind, label, rank: the top of every kind of thing that a query may mean; None without words."""
    if not params.terms(q):
        return None
    parts = [
        _ranked(works.join(match(texts, q), "work_id"), "title", "title", params.clamp(limit, 7, 20), F.col("score").asc(), F.col("work_id").asc()),
        _ranked(containing(authors, "name_fold", q), "author", "name", 5, F.col("n_works").desc(), F.col("name").asc()),
        _ranked(merged_publishers(containing(publishers, "name_fold", q)), "publisher", "name", 4, F.col("n").desc(), F.col("name").asc()),
        _ranked(_merged_genres(containing(genres, text.fold("name"), q)), "genre", "name", 4, F.col("n").desc(), F.col("name").asc()),
        _ranked(containing(lists, text.fold("name"), q), "list", "name", 4, F.col("name").asc(), F.col("slug").asc()),
        _ranked(containing(languages, "name_fold", q), "language", "name", 3, F.col("n").desc(), F.col("name").asc()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merged_genres(genres: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n_works")).alias("n"), F.col("name").alias("name")))["name"]
    return genres.groupBy(text.fold("name").alias("fold")).agg(best.alias("name"), F.sum("n_works").alias("n"))


def _ranked(df: DataFrame, kind: str, label: str, n: int, *order: Column) -> DataFrame:
    few = df.orderBy(*order).limit(n)  # at most 20 rows, so ranking them is one small task
    return few.select(F.lit(kind).alias("kind"), F.col(label).alias("label"), F.row_number().over(W.orderBy(*order)).alias("rank"))


NEAR_KINDS = ("author", "list", "publisher", "genre", "title")


def near_matches(suggestions: DataFrame | None, limit: int = 6, titles: bool = True) -> DataFrame | None:
    """The first few suggestions, whole destinations before single titles."""
    if suggestions is None:
        return None
    kinds = [k for k in NEAR_KINDS if titles or k != "title"]
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return suggestions.where(F.col("kind").isin(*kinds)).orderBy(place, "rank").limit(limit)


def facet_values(authors: DataFrame, publishers: DataFrame, kind: str, q: str = "", limit: object = 30) -> DataFrame | None:
    """Values of a large facet that contain q, most titles first."""
    n = params.clamp(limit, 30, 50)
    q = q.strip()
    if kind == "author":
        df, by = authors.where("n_works > 0"), "n_works"
    elif kind == "publisher":
        df, by = publishers, "n"
    else:
        return None
    found = containing(df, "name_fold", q) if q else df
    return found.orderBy(F.desc(by), "name").limit(n).select(F.col("name").alias("value"), F.col(by).alias("n"))
