"""Filters, joins, aggregates, windows and sorts in the shapes that the catalog uses, over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import params, text
from shelfspark.operators import search
from shelfspark.session import table


def filter_multi(s, d):
    f = params.SearchFilters(languages=("en", "fr"), year_from=500, year_to=4000)
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), "source", F.col("n_chars").alias("year"))
    return params.filtered(docs, f).where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "language", "year")


def page_offset(s, d):
    return params.page(table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"), 4, 24).select("o_orderkey", "o_totalprice")


def nulls_last(s, d):
    rank = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey"))
    return params.page(table(s, d, "orders").withColumn("added_rank", rank).orderBy(F.col("added_rank").asc_nulls_last(), "o_orderkey"), 1, 96).select("o_orderkey", "added_rank")


def top_k(s, d):
    return table(s, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(40).select("l_orderkey", "l_linenumber", "l_extendedprice")


def semi_filter(s, d):
    big = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_missing(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def left_count(s, d):
    items = table(s, d, "labels").select("doc_id", "quality")
    joined = table(s, d, "documents").select("source", "doc_id").join(items, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("labelled"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).cast("bigint").alias("good"), F.count(F.lit(1)).alias("total"))


def left_items(s, d):
    items = table(s, d, "labels").select("doc_id", "toxic")
    return table(s, d, "documents").select("doc_id", "lang").join(items, "doc_id", "left")


def first_match(s, d):
    """Two-key lookup with priority: the customer of a like-numbered supplier's nation, else of its name's digits; first slot wins."""
    sup = table(s, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 50).alias("k2"))
    by_nation = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("a")).where("s_nationkey % 2 = 0")
    by_key = table(s, d, "customer").groupBy((F.col("c_custkey") % 60).alias("k2")).agg(F.min("c_custkey").alias("b"))
    found = sup.join(by_nation, "s_nationkey", "left").join(by_key, "k2", "left").withColumn("c", F.coalesce("a", "b"))
    slot = F.row_number().over(W.partitionBy("c").orderBy("s_suppkey"))
    return found.withColumn("custkey", F.when(slot == 1, F.col("c"))).select("s_suppkey", "custkey")


def self_rep(s, d):
    li = table(s, d, "lineitem")
    first = li.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("rep_flag"))
    grouped = li.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("any_flag"), F.count(F.lit(1)).alias("n"))
    return grouped.join(first, "l_orderkey", "left").select("l_orderkey", F.coalesce("rep_flag", "any_flag").alias("flag"), "n")


def parent_join(s, d):
    r = table(s, d, "region")
    return table(s, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.col("r_name").alias("parent"))  # the region table has a fixed size


def slice_summary(s, d):
    li = table(s, d, "lineitem")
    return li.where("l_shipdate >= '1995-01-01'").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).cast("bigint").alias("returned"), F.sum((F.col("l_linestatus") == "O").cast("int")).cast("bigint").alias("open"), F.min(F.nullif(F.col("l_quantity"), F.lit(1.0))).alias("least"), F.max("l_quantity").alias("most"))


def longest_per_source(s, d):
    longest = F.min(F.struct((-F.length("text")).alias("n"), F.col("doc_id").alias("doc_id")))
    return table(s, d, "documents").groupBy("source").agg(longest["doc_id"].alias("doc_id"), (-longest["n"]).cast("bigint").alias("n"))


def majority_brand(s, d):
    from shelfspark.plans.catalog import majority

    return majority(table(s, d, "part"), ["p_type"], "p_brand")


def pooled_names(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"))


def letter_histogram(s, d):
    return table(s, d, "part").groupBy(text.letter("p_name").alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def having_audit(s, d):
    docs = table(s, d, "documents")
    g = docs.groupBy("source").agg(F.countDistinct("lang").alias("langs"), (F.max("n_chars") - F.min(F.nullif("n_chars", F.lit(0)))).alias("span"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1 AND (langs > 2 OR span > 5000)")


def size_histogram(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


def merged_publishers(s, d):
    pubs = table(s, d, "part").groupBy(F.col("p_name").alias("name"), text.fold(F.split("p_name", " ")[0]).alias("name_fold")).agg(F.count(F.lit(1)).alias("n"))
    return search.merged_publishers(pubs)


def revenue_by_nation(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed number
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


def rollup_cube(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def set_ops(s, d):
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    even = a.where("doc_id % 2 = 0")
    return even.intersect(b).withColumn("part", F.lit("both")).unionByName(b.exceptAll(even).withColumn("part", F.lit("labels only")))


def asof_join(s, d):
    """For each purchase the latest earlier event of its user: one window over the union, no range join."""
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("before", F.last("event_id").over(order)).where(F.col("event_type") == "purchase").select("event_id", "before")


def range_join(s, d):
    """Events in fixed day bands of value: a join on the band number with the exact test after."""
    bands = s.range(0, 50).select(F.col("id").cast("int").alias("band"), (F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 10.0).alias("high"))
    e = table(s, d, "events").withColumn("band", F.floor(F.col("value") / 10).cast("int"))
    joined = e.join(bands, "band").where((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def conversation_state(s, d):
    """A carried state in order of turn: the last role before, and whether a turn is the first of its role."""
    c = table(s, d, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    first = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")) == 1
    last_user = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(order)
    return c.select("conv_id", "turn", F.lag("role").over(order).alias("before"), first.alias("first_of_role"), last_user.alias("last_user_turn"))


ALL = {
    "filter_multi": (filter_multi, "SELECT doc_id, lang AS language, n_chars AS year FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 4000 AND source IN ('src1', 'src2', 'src3')"),
    "page_offset": (page_offset, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 72"),
    "added_nulls_last": (nulls_last, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS added_rank FROM orders ORDER BY 2 NULLS LAST, 1 LIMIT 96"),
    "top_k": (top_k, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40"),
    "semi_filter": (semi_filter, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "anti_missing": (anti_missing, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "left_count": (left_count, "SELECT source, count(quality) AS labelled, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"),
    "left_items": (left_items, "SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "first_match_join": (first_match, """SELECT s_suppkey, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY s_suppkey) = 1 THEN c END AS custkey FROM (
      SELECT s_suppkey, coalesce(a, b) AS c FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS a FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) ON s_nationkey = c_nationkey
      LEFT JOIN (SELECT c_custkey % 60 AS k2, min(c_custkey) AS b FROM customer GROUP BY 1) ON s_suppkey % 50 = k2)"""),
    "self_rep": (self_rep, "SELECT l_orderkey, coalesce(max(CASE WHEN l_linenumber = 1 THEN l_returnflag END), max(l_returnflag)) AS flag, count(*) AS n FROM lineitem GROUP BY l_orderkey"),
    "parent_join": (parent_join, "SELECT n_name, r_name AS parent FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "slice_summary": (slice_summary, "SELECT sum((l_returnflag = 'R')::INT)::BIGINT AS returned, sum((l_linestatus = 'O')::INT)::BIGINT AS open, min(nullif(l_quantity, 1)) AS least, max(l_quantity) AS most FROM lineitem WHERE l_shipdate >= '1995-01-01'"),
    "longest_summary": (longest_per_source, "SELECT source, arg_min(doc_id, (-length(text), doc_id)) AS doc_id, max(length(text))::BIGINT AS n FROM documents GROUP BY source"),
    "majority_spelling": (majority_brand, "SELECT p_type, arg_min(p_brand, (-n, p_brand)) AS p_brand FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type"),
    "pooled_text": (pooled_names, "SELECT p_brand, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY p_brand"),
    "letter_histogram": (letter_histogram, "SELECT CASE WHEN upper(left(p_name, 1)) BETWEEN 'A' AND 'Z' THEN upper(left(p_name, 1)) ELSE 'overig' END AS letter, count(*) AS n FROM part GROUP BY 1"),
    "having_audit": (having_audit, "SELECT source, count(DISTINCT lang) AS langs, max(n_chars) - min(nullif(n_chars, 0)) AS span, count(*) AS n FROM documents GROUP BY source HAVING n > 1 AND (langs > 2 OR span > 5000)"),
    "size_histogram": (size_histogram, "SELECT n, count(*) AS customers FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "merged_publishers": (merged_publishers, "SELECT name_fold, arg_min(name, (-n, -length(name), name)) AS name, sum(n)::BIGINT AS n FROM (SELECT p_name AS name, lower(string_split(p_name, ' ')[1]) AS name_fold, count(*) AS n FROM part GROUP BY ALL) GROUP BY name_fold"),
    "revenue_by_nation": (revenue_by_nation, "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "rollup": (rollup_cube, "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "set_ops": (set_ops, "SELECT doc_id, 'both' AS part FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labels only' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE doc_id % 2 = 0)"),
    "asof_join": (asof_join, "SELECT event_id, before FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = 'purchase'"),
    "range_join": (range_join, "SELECT floor(value / 10)::INTEGER AS band, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY 1"),
    "conversation_state": (conversation_state, "SELECT conv_id, turn, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS first_of_role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS last_user_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
}
