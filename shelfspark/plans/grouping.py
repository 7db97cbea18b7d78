"""Editions to works: entity resolution by key buckets, cross-links and curated pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.functions import text
from shelfspark.operators import graph


def work_keys(editions: DataFrame) -> DataFrame:
    """ppn, title_key, surname and lang (the folds) of every edition."""
    first = F.try_element_at(text.split_authors("author"), F.lit(1))
    return editions.select("ppn", text.fold(text.strip_format_noise("title")).alias("title_key"), text.surname_key(first).alias("surname"), text.fold("language").alias("lang"))


def bucket_edges(keys: DataFrame) -> DataFrame:
    """Stars, never pairs: each edition to the least ppn of its key and language.

    An edition without a language joins a key's only language, if there is exactly one. Titles that
    fold to nothing are never keyed. Bucket minima are combined before they are shuffled, so a key
    that very many editions share costs a row a task.
    """
    keyed = keys.where(F.col("title_key") != "")
    heads = keyed.where(F.col("lang") != "").groupBy("title_key", "surname", "lang").agg(F.min("ppn").alias("head"))
    same = keyed.join(heads, ["title_key", "surname", "lang"]).select(F.col("ppn").alias("u"), F.col("head").alias("v"))
    only = heads.groupBy("title_key", "surname").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("head")).where("n = 1")
    unknown = keyed.where(F.col("lang") == "").join(only, ["title_key", "surname"]).select(F.col("ppn").alias("u"), F.col("head").alias("v"))
    return same.unionByName(unknown)


def link_edges(editions: DataFrame) -> DataFrame:
    """The catalog's own cross-links, to editions that it holds."""
    links = editions.select(F.col("ppn").alias("u"), F.explode("related_ppns").alias("v"))
    return links.join(editions.select(F.col("ppn").alias("v")), "v", "left_semi").select("u", "v")


def group_editions(editions: DataFrame, merges: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """ppn, work_id for every edition; work_id is the group's representative: an e-book first, then the least ppn.

    editions: ppn, title, author, language, format, related_ppns. merges, splits: curated pairs
    (a, b); a merge joins their groups, a split takes b out of the group it shares with a, after all
    else, so the first keeps the group.
    """
    known = editions.select("ppn")
    keys = workspace.materialize(work_keys(editions), "work_keys")  # folded once, read by several joins
    parts = [bucket_edges(keys), link_edges(editions)]
    if merges is not None:
        held = merges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        parts.append(held.join(known.withColumnRenamed("ppn", "u"), "u", "left_semi").join(known.withColumnRenamed("ppn", "v"), "v", "left_semi"))
    roots = graph.components(reduce(DataFrame.unionByName, parts).select("u", "v"))
    grouped = known.join(roots.withColumnRenamed("node", "ppn"), "ppn", "left").select("ppn", F.coalesce("root", "ppn").alias("root"))
    if splits is not None:
        ends = splits.join(grouped.select(F.col("ppn").alias("a"), F.col("root").alias("ra")), "a").join(grouped.select(F.col("ppn").alias("b"), F.col("root").alias("rb")), "b")
        out = ends.where((F.col("ra") == F.col("rb")) & (F.col("a") != F.col("b"))).select(F.col("b").alias("ppn"), F.lit(True).alias("alone")).distinct()
        grouped = grouped.join(out, "ppn", "left").select("ppn", F.when(F.col("alone"), F.concat(F.lit("split:"), "ppn")).otherwise(F.col("root")).alias("root"))
    rank = F.struct(F.coalesce(F.col("format") != "ebook", F.lit(True)).alias("other"), F.col("ppn").alias("ppn"))
    formed = grouped.join(editions.select("ppn", "format"), "ppn")
    heads = formed.groupBy("root").agg(F.min(rank)["ppn"].alias("work_id"))
    return grouped.join(heads, "root").select("ppn", "work_id")
