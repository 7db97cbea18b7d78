import pytest

from shelfspark.plans import catalog, grouping
from tests.sample import WORK_OF, editions, list_items, rows


@pytest.fixture(scope="module")
def tables(spark):
    built = catalog.build(editions(spark))
    return {k: v.cache() for k, v in built.items()}


def test_groups_the_nine_editions_into_five_works(spark):
    assert dict(rows(grouping.group_editions(editions(spark)))) == WORK_OF


def test_merge_and_split_pairs(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
    got = dict(rows(grouping.group_editions(editions(spark), merges=pair("003", "006"), splits=pair("001", "002"))))
    assert got["006"] == "003" and got["002"] == "002" and got["001"] == got["007"] == "001"
    # A split never loses the rest of a group, even if it takes out the group's least ppn.
    got = dict(rows(grouping.group_editions(editions(spark), splits=pair("002", "001"))))
    assert got["001"] == "001" and got["002"] == got["007"] == "002"


def test_unknown_language_joins_only_an_unambiguous_bucket(spark):
    schema = "ppn string, title string, author string, format string, language string, related_ppns array<string>"
    e = spark.createDataFrame([("1", "A", "X Y", "ebook", "Engels", None), ("2", "A", "X Y", "ebook", None, None), ("3", "B", "X Y", "ebook", "Engels", None), ("4", "B", "X Y", "ebook", "Frans", None), ("5", "B", "X Y", "ebook", None, None), ("6", "C", "X Y", "ebook", None, None), ("7", "C", "X Y", "audiobook", None, None), ("8", "!!", "X Y", "ebook", "Engels", ["1", "99"]), ("9", "!!", "X Y", "ebook", "Engels", None)], schema)
    assert dict(rows(grouping.group_editions(e))) == {"1": "1", "2": "1", "8": "1", "3": "3", "4": "4", "5": "5", "6": "6", "7": "7", "9": "9"}


def test_work_rollup(tables):
    got = {r["work_id"]: r for r in tables["works"].collect()}
    one = got["001"]
    assert (one["year"], one["n_editions"], one["has_ebook"], one["has_audiobook"], one["audiobook_ppn"], one["added_rank"]) == (2020, 3, 1, 1, "002", 1)
    assert "walvisexpeditie" in one["summary"]
    assert got["003"]["has_audiobook"] == 0 and got["004"]["series"] == "Het Mysterie" and got["005"]["keywords"] == "pasta, italiaans"


def test_majority_spelling_and_links(tables):
    people = {r["author_key"]: r for r in tables["authors"].collect()}
    assert people["bob de wit"]["name"] == "Bob de Wit" and people["bob de wit"]["n_works"] == 2
    assert people["bob de wit"]["surname_sort"] == "wit" and people["bob de wit"]["surname_letter"] == "W"
    assert rows(tables["work_authors"].where("work_id = '003'"), "author_key", "position") == [("bob de wit", 0), ("cara licht", 1)]
    assert ("Literatuur & Romans", 2) in rows(tables["genres"], "name", "n_works")


def test_slugs_and_pooled_text(tables):
    assert ("001", "de-ontdekking--anna-vrij") in rows(tables["slugs"])
    text = {r["work_id"]: r for r in tables["works_fts"].collect()}
    assert "walvisexpeditie" in text["001"]["summary"] and "pasta" in text["005"]["subjects"] and "luisterboek" in text["005"]["title"]


def test_lists_match_by_isbn_then_key_and_keep_the_first_slot(spark):
    e = editions(spark)
    work_of = grouping.group_editions(e)
    got = rows(catalog.match_lists(list_items(spark), e, work_of), "position", "work_id")
    assert got == [(1, "001"), (2, None), (3, "003"), (4, None)]


def test_ereader_precedence(spark):
    r = spark.createDataFrame([("1", "A", "X", "ebook", "Engels", "P", None, "2020"), ("2", "B", "X", "ebook", "Engels", "P", None, "2020"), ("3", "C", "X", "ebook", "Engels", "P", None, "2030"), ("4", "D", "X", "ebook", "Engels", "P", 0, "2020"), ("5", "E", "X", "audiobook", "Engels", "P", None, "2020")], "ppn string, title string, author string, format string, language string, publisher string, ereader int, first_seen string")
    side = spark.createDataFrame([("1",), ("4",)], "ppn string")
    assert rows(catalog.transform(r, ereader=side, ereader_stamp="2025"), "ppn", "ereader") == [("1", 1), ("2", 0), ("3", None), ("4", 0), ("5", None)]
    prior = spark.createDataFrame([("3", 1)], "ppn string, ereader int")
    assert rows(catalog.transform(r, prior=prior), "ppn", "ereader") == [("1", None), ("2", None), ("3", 1), ("4", 0), ("5", None)]


def test_genre_parents_and_trees(spark):
    schema = "ppn string, audience string, genres array<struct<code string, name string>>"
    r = spark.createDataFrame([("1", "Jeugd", [("2.0", "Natuur"), ("2.6", "Dieren")]), ("2", "Volwassenen", [("2.0", "Romans"), ("2.6", "Dieren")]), ("3", "Volwassenen", [("2.0", "Romans")]), ("4", "Volwassenen", [("2.0", "Natuur")])], schema)
    parents = catalog.genre_parents(r)
    assert rows(parents) == [("jeugd", "Dieren", "Natuur"), ("volwassenen", "Dieren", "Romans")]
    links = r.selectExpr("ppn as work_id", "explode(genres) g").selectExpr("work_id", "g.name as genre")
    pages, tree = catalog.genre_taxonomy(links, parents, r.selectExpr("ppn as work_id", "audience"))
    assert ("jeugd", "dieren", "natuur", 1) in rows(tree) and ("volwassenen", "dieren", "romans", 1) in rows(tree)
    assert ("romans", "Romans", 2, "") in rows(pages)


def test_publish_moves_the_pointer(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/cat"
    catalog.publish({"works": tables["works"]}, folder, "v1")
    catalog.publish({"works": tables["works"].limit(2)}, folder, "v2")
    assert catalog.read_published(spark, folder, "works").count() == 2
    assert spark.read.parquet(f"{folder}/v1/works").count() == 5


def test_a_run_that_ends_early_leaves_the_last_version(spark, tmp_path):
    """Leftovers of every step: a version without a pointer, a pointer that was not committed, a lost pointer."""
    import os
    import shutil

    from shelfspark.streaming import ingest

    folder = f"file://{tmp_path}/store"
    with pytest.raises(LookupError):
        catalog.read_published(spark, folder, "store")
    assert ingest.current_store(spark, folder).count() == 0
    rows = lambda n: spark.range(n).selectExpr("cast(id as string) AS ppn", "'r' AS record", "NULL AS detail_html", "'T' AS first_seen", "NULL AS updated_at", "NULL AS detail_at", "NULL AS removed_at")
    for n in (1, 2, 3):
        catalog.publish({"store": rows(n)}, folder, f"v{n}")
    assert ingest.current_store(spark, folder).count() == 3
    assert sorted(os.listdir(tmp_path / "store")) == ["CURRENT", "v2", "v3"] and len(os.listdir(tmp_path / "store/CURRENT")) == 2
    rows(9).write.parquet(f"{folder}/v4/store")  # written, not pointed to
    os.makedirs(tmp_path / "store/CURRENT/n=4")  # begun, not committed
    assert ingest.current_store(spark, folder).count() == 3
    catalog.publish({"store": rows(5)}, folder, "v4")
    assert ingest.current_store(spark, folder).count() == 5 and sorted(os.listdir(tmp_path / "store")) == ["CURRENT", "v3", "v4-5"]
    shutil.rmtree(tmp_path / "store/CURRENT")
    with pytest.raises(OSError):
        ingest.current_store(spark, folder)
