import numpy as np

from shelfspark.functions import params
from shelfspark.operators import browse, search, similar
from shelfspark.plans import catalog, testdata
from shelfspark.queries import search_queries
from tests.sample import F, editions, rows


def test_field_weights_rank_subject_over_summary(spark):
    fill = [(f"F{i:02}", "Zelfde titel", "X", "", "niets") for i in range(20)]
    docs = spark.createDataFrame([("SUM", "Zelfde titel", "X", "", "walvis"), ("SUB", "Zelfde titel", "X", "walvis", ""), *fill], "work_id string, title string, author string, subjects string, summary string")
    assert [r["work_id"] for r in search.match(docs, "walv").orderBy("score").collect()] == ["SUB", "SUM"]
    assert search.match(docs, "walv titel").count() == 2 and search.match(docs, "!!!").count() == 0
    assert search.count_matches(docs, "walv").first()[0] == 2


def test_search_pools_the_text_of_all_editions(spark):
    t = catalog.build(editions(spark))
    f = lambda **k: params.SearchFilters(**k)
    found = lambda x: [r["work_id"] for r in search.search(t["works"], t["works_fts"], x, work_authors=t["work_authors"], work_genres=t["work_genres"]).collect()]
    assert found(f(q="walvisexp")) == ["001"] and found(f(q="espana")) == ["001"] and found(f(q="españa anna")) == ["001"]
    assert found(f(q="pasta", format="audiobook")) == ["005"] and found(f(q="pasta", languages=("Engels",))) == []
    assert found(f(authors=("BOB DE WIT",), sort="year_asc")) == ["003", "004"]
    assert found(f(genres=("Literatuur & Romans",), ereader=True)) == ["001"] and found(f(year_from=2019, year_to=2020, sort="year_desc")) == ["001", "006"]
    counts = browse.dashboard_counts(t["works"], t["editions"], t["authors"], t["publishers"]).first()
    assert (counts["total"], counts["editions"], counts["audiobooks"]) == (5, 9, 3)
    assert rows(browse.work_ref(t["works"], t["editions"], "002")) == [("001",)] and rows(browse.work_ref(t["works"], t["editions"], "zzz")) == []
    assert rows(browse.facets(t["works"], t["genres"], t["publishers"], t["authors"], spark.createDataFrame([], "slug string, name string"))["formats"]) == [("audiobook",), ("ebook",)]


def test_a_query_that_folds_to_nothing_contains_in_every_name(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "name_fold string")
    assert search.containing(df, "name_fold", "Αθ").count() == 2 and search.containing(df, "name_fold", "A").count() == 1


def test_trees_and_lists(spark):
    tree = spark.createDataFrame([("jeugd", "a", "", 5), ("jeugd", "b", "a", 2), ("jeugd", "c", "a", 3), ("jeugd", "d", "", 9), ("volwassenen", "a", "", 1)], "audience string, slug string, parent_slug string, titles int")
    pages = spark.createDataFrame([(x, x.upper(), 1, "") for x in "abcd"], "slug string, name string, titles int, parent_slug string")
    got = [(r["slug"], [c["slug"] for c in r["children"]]) for r in browse.genre_tree(tree, pages, "jeugd").collect()]
    assert got == [("d", []), ("a", ["c", "b"])]
    lists = spark.createDataFrame([("x", "X"), ("leeg", "Leeg")], "slug string, name string")
    items = spark.createDataFrame([("x", 1, "001"), ("x", 2, None)], "list string, position int, work_id string")
    assert [(r["slug"], r["total"], r["available"]) for r in browse.lists_overview(lists, items, "pct").collect()] == [("x", 2, 1), ("leeg", 0, 0)]


def test_shown_genres_hide_a_parent_shown_beside_its_child(spark):
    g = spark.createDataFrame([("1", "Top"), ("1", "Kind"), ("1", "Los")], "work_id string, genre string")
    w = spark.createDataFrame([("1", "Jeugd")], "work_id string, audience string")
    p = spark.createDataFrame([("jeugd", "Kind", "Top")], "audience string, genre string, parent string")
    assert rows(browse.shown_genres(g, w, p).select("genre")) == [("Kind",), ("Los",)]


def test_neighbours_are_others_in_order_and_above_the_floor(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 0.1]), ("e", None)], "work_id string, vector array<double>")
    got = rows(similar.cosine_neighbours(v, 2, 0.1, block=2), "work_id", "rank", "other")
    assert ("b", 0, "d") in got and ("a", 0, "b") in got and ("a", 1, "d") in got
    assert not [g for g in got if g[0] == g[2]] and not [g for g in got if g[0] == "c" and g[2] == "a"]


def test_lsa_invariants(spark):
    t = catalog.build(editions(spark))
    edges = similar.build_similar(t["works"], t["work_genres"], dimensions=3)
    got = edges.collect()
    assert all(r["work_id"] != r["other"] and r["score"] >= 0.1 for r in got)
    assert len({(r["work_id"], r["rank"]) for r in got}) == len(got) == len({(r["work_id"], r["other"]) for r in got})
    assert similar.neighbours_of(None, t["works"], "001").count() == 0


def test_neighbours_in_chunks_are_those_of_brute_force(spark):
    """Copies of a vector lie in several chunks and blocks: ties go to the least key wherever they lie."""
    some = np.random.default_rng(3).standard_normal((40, 7))
    every = np.concatenate([some, some[:20], some[:20], some[:5]])
    v = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(every)], "work_id string, vector array<double>").repartition(3)
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    score = (unit[:, None, :] * unit[None, :, :]).sum(axis=2)
    want = {i: sorted((-score[i, j], f"{j:03}") for j in range(len(every)) if i != j and score[i, j] >= 0.1)[:6] for i in range(len(every))}
    for queries, asked in ((None, range(len(every))), (F.col("work_id").cast("long") % 10 == 0, range(0, len(every), 10))):
        got = rows(similar.cosine_neighbours(v, 6, 0.1, block=4, queries=queries, chunk_bytes=700), "work_id", "rank", "other", "score")
        assert sorted(got) == [(f"{i:03}", r, o, round(-s, 4)) for i in asked for r, (s, o) in enumerate(want[i])]


def test_lsa_rows_are_hashed_tf_idf_however_few_tokens_are_common(spark):
    e = editions(spark).withColumnRenamed("ppn", "work_id").withColumn("summary", F.concat("summary", F.lit(" walvis boot walvis"))).select("work_id", "title", "summary", "keywords")
    e = e.unionByName(e.where("work_id < '003'").withColumn("summary", F.lit("walvis haven")))  # works that occur twice
    g = e.select("work_id", F.lit("Roman").alias("genre")).where("work_id > '003'").unionByName(spark.createDataFrame([("004", "Zee"), ("zzz", "Zee"), ("005", None)], "work_id string, genre string"))
    weights, want = similar.tf_idf(similar.bags(e, g)).withColumn("t", F.xxhash64("token")).collect(), {}
    for r in weights:
        x = want.setdefault(r["work_id"], np.zeros(64))
        x[r["t"] % 64] += r["weight"] * (1 - 2 * (r["t"] >> 32 & 1))
    for common in (1 << 20, 2, 0):
        got = {r["work_id"]: r for r in similar.lsa_rows(similar.counted(e), g, features=64, common=common).collect()}
        assert len(want) > 3 and got.keys() == want.keys()
        for i, r in got.items():
            x = np.zeros(64)
            x[np.frombuffer(r["f"], np.int16)] = np.frombuffer(r["x"], np.float32)
            assert np.allclose(x, want[i], atol=1e-6)


def test_registered_neighbours_move_no_tokens_and_no_vectors_for_meetings(spark, tmp_path, monkeypatch):
    docs = [(i, f"Een titel\n{'walvis ' * (i % 3 + 1)}{'boot ' * (i % 5)}", "en", "src", 1) for i in range(1, 402)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(similar.cosine_neighbours, "__defaults__", (*similar.cosine_neighbours.__defaults__[:-1], 20_000))
    plans, written = [], similar.workspace.materialize
    monkeypatch.setattr(similar.workspace, "materialize", lambda df, name, *a, **k: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), written(df, name, *a, **k))[1])
    got = search_queries.lsa(spark, str(tmp_path)).collect()
    assert {r["work_id"] for r in got} == {f"{i:09}" for i in (100, 200, 300, 400)} and len(got) == 4 * similar.NEIGHBOURS
    meetings = [p for name, p in plans if name == "asking"][1:]
    assert len(meetings) > 1 and all("CartesianProduct" in p and "Exchange" not in p for p in meetings)
    assert all("hashpartitioning(token" not in p for name, p in plans if name in ("counted_tokens", "lsa_rows"))


def test_registered_suggestions_hold_titles_by_score(spark, monkeypatch):
    t = catalog.build(editions(spark))
    monkeypatch.setattr(search_queries, "snapshot", lambda s, d: t)
    got = [(r["kind"], r["label"]) for r in search_queries.suggest(spark, "").orderBy("kind", "rank").collect()]
    hits = search.match(t["works_fts"], "bob").join(t["works"], "work_id").orderBy("score", "work_id")
    titles = [("title", r["title"]) for r in hits.limit(7).collect()]
    assert len(titles) == 2 and [g for g in got if g[0] == "title"] == titles and ("author", "Bob de Wit") in got
    near = [(r["kind"], r["label"]) for r in search_queries.near(spark, "").collect()]
    assert [k for k, _ in near] == ["author", "list", "title", "title"] and near[2:] == titles


def test_registered_tf_idf_weighs_the_words_of_whole_texts(spark, monkeypatch):
    e = editions(spark).where("ppn IN ('003', '005')").withColumn("summary", F.lit("zeldzaam verhaal " * 50))
    monkeypatch.setattr(search_queries, "editions", lambda s, d: e)
    got = {r["work_id"]: r["terms"] for r in search_queries.tf_idf(spark, "").collect()}
    assert got == {"003": 2, "005": 2}  # the titles, genres and keywords of the two differ


def test_texts_in_pieces_match_as_pooled_ones(spark):
    """A work of many editions, whose pooled text is one long row, has no row beyond its longest text."""
    t = catalog.build(editions(spark))
    more = t["editions"].where("ppn = '001'").crossJoin(spark.range(200)).withColumn("summary", F.concat("summary", F.lit(" walvis "), (F.col("id") % 150).cast("string"))).drop("id")
    every = t["editions"].unionByName(more)
    pooled, pieces = catalog.pooled_text(every, t["work_genres"]), catalog.text_pieces(every, t["work_genres"])
    longest = lambda df: df.agg(F.max(F.length("summary"))).first()[0]
    assert longest(pieces) < 60 < 3000 < longest(pooled)
    plain = lambda df: sorted((r["work_id"], round(r["score"], 9)) for r in df.collect())
    for q in ("walvis", "de", "bob", "pasta", "an ont"):
        want = plain(search.match(pooled, q))
        assert want and plain(search.match(pieces, q)) == want
        assert plain(search.match_index(search.postings(pieces), search.lengths(pieces), q)) == want
    assert rows(search.lengths(pieces), "work_id", "dl") == rows(search.lengths(pooled), "work_id", "dl")


def test_the_snapshot_holds_texts_in_pieces(spark, tmp_path):
    docs = [(i, f"Een titel\n{'woord ' * 50}{i}", "en", "src", 1) for i in range(1, 40, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    t = testdata.snapshot(spark, str(tmp_path))
    assert t["works"].count() < len(docs) and t["works_fts"].agg(F.max(F.length("summary"))).first()[0] < 400
