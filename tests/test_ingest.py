import pytest

from shelfspark.functions import register, text
from shelfspark.plans import ingest
from shelfspark.sources import raw_store
from tests.sample import rows
from tests.test_sources import DETAIL

SCHEMA = "ppn string, slug string, title string, author string, year int, publisher string, format string, summary string, isbn string"


def pager(found):
    return lambda cell, n: found.get((cell, n), ([], None))


def test_cells_dedupe_resume_and_stay_open_on_failure():
    a, b = ingest.Cell("ebook", "dut"), ingest.Cell("ebook", "eng")
    found = {(a, 1): ([{"ppn": "1"}, {"ppn": "2"}], 2), (a, 2): ([{"ppn": "2"}], None), (b, 1): ([{"ppn": "2"}, {"ppn": "3"}], 2)}
    w = ingest.walk_cells([a, b], pager(found), set(), 2026)
    assert sorted(w.rows) == ["1", "2", "3"] and w.cells == [("ebook:dut", "ebook", 2, 2), ("ebook:eng", "ebook", 1, 2)]
    assert ingest.walk_cells([a, b], pager(found), {"ebook:dut"}, 2026).cells == [("ebook:eng", "ebook", 2, 2)]
    assert len(ingest.walk_cells([a, b], pager(found), {"ebook:dut", "ebook:eng"}, 2026).cells) == 2

    def broken(cell, n):
        if cell == a:
            raise OSError
        return found.get((cell, n), ([], None))

    done = set()
    w = ingest.walk_cells([a, b], broken, done, 2026)
    assert w.failed == ["ebook:dut"] and done == {"ebook:eng"}


def test_a_capped_cell_is_split_by_year_and_by_the_other_order():
    a = ingest.Cell("ebook", "dut")
    found = {(a, 1): ([{"ppn": "1"}], 3), (ingest.Cell("ebook", "dut", 1851), 1): ([{"ppn": "2"}], 1), (ingest.Cell("ebook", "dut", None, "maker"), 1): ([{"ppn": "3"}], 3)}
    w = ingest.walk_cells([a], pager(found), set(), 2026, cap=1)
    assert w.cells == [("ebook:dut", "ebook", 3, 3)]


def test_resume_state_expires(spark, tmp_path):
    p = f"{tmp_path}/done"
    assert ingest.load_done(spark, p, 0.0) == set()
    ingest.save_done(spark, p, {"a", "b"}, 1000.0)
    assert ingest.load_done(spark, p, 2000.0) == {"a", "b"} and ingest.load_done(spark, p, 1000.0 + 25 * 3600) == set()


def feed(spark, *rs):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rs)], "position int, ppn string, title string, author string, year int, publisher string, format string, summary string")


def test_sync_stops_on_a_streak_and_keeps_what_listings_lack(spark):
    body = lambda k, t: (k, f'{{"isbn":"i{k}","ppn":"{k}","title":"{t}"}}')
    s = raw_store.put(raw_store.empty(spark), spark.createDataFrame([body(str(k), "T") for k in range(1, 6)], "ppn string, record string"), "T1")
    row = lambda k, t: (k, t, None, None, None, None, None)
    after = ingest.sync(s, feed(spark, row("9", "new"), row("1", "changed"), row("2", "T"), row("3", "T"), row("4", "beyond")), SCHEMA, "T2", streak=2)
    got = {r["ppn"]: r for r in raw_store.records(after, SCHEMA).collect()}
    assert got["9"]["first_seen"] == "T2" and got["1"]["title"] == "changed" and got["1"]["isbn"] == "i1" and got["1"]["updated_at"] == "T2"
    assert got["4"]["title"] == "T" and got["2"]["updated_at"] is None and len(got) == 6


def test_pages_and_full_runs(spark):
    s = raw_store.put(raw_store.empty(spark), spark.createDataFrame([("41672x", '{"isbn":"i","ppn":"41672x","slug":"s"}'), ("2", '{"ppn":"2"}')], "ppn string, record string"), "T1")
    assert rows(raw_store.without_page(s)) == [("41672x", "s")]
    s = ingest.add_pages(s, spark.createDataFrame([("41672x", DETAIL)], "ppn string, html string"), SCHEMA, "T2")
    got = {r["ppn"]: r for r in raw_store.records(s, SCHEMA).collect()}
    assert got["41672x"]["title"] == "De Titel" and got["41672x"]["isbn"] == "i" and got["41672x"]["detail_at"] == "T2" and len(got) == 2
    seen = feed(spark, ("41672x", "De Titel", None, None, None, None, None)).drop("position")
    cells = spark.createDataFrame([("c", 1, 1)], "cell string, got int, claimed int")
    expected = spark.createDataFrame([("c", "ebook")], "cell string, format string")
    after, marked = ingest.full_run(s, seen, cells, expected, SCHEMA, "T3", all_formats=False)
    assert not marked and after.where("removed_at IS NOT NULL").count() == 0
    after, marked = ingest.full_run(s, seen, cells, expected, SCHEMA, "T3", all_formats=True)
    assert marked and rows(after.where("removed_at = 'T3'"), "ppn") == [("2",)]


def test_refresh_is_ordered_and_single():
    log = []

    def fail():
        raise RuntimeError

    assert ingest.refresh([("a", lambda: log.append(ingest.refresh([]))), ("b", lambda: None)]) == ["a", "b"] and log == [None]
    assert ingest.refresh([("a", lambda: None), ("b", fail), ("c", lambda: None)]) == ["a"]
    assert ingest.optional(fail, None) is None


def test_methods_are_replaced_and_stale_ones_drop(spark):
    e = lambda *r: spark.createDataFrame(list(r), "work_id string, method string")
    assert rows(ingest.replace_method(e(("1", "lsa"), ("1", "old"), ("1", "other")), e(("2", "lsa")), ("lsa", "other"))) == [("1", "other"), ("2", "lsa")]
    assert ingest.replace_method(None, e(("2", "lsa")), ("lsa",)).count() == 1


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT fold('Crème ﬁn!') f, slug('Lisbeth Imbo') s, publisher_key('De X, [Y].') p, fold(NULL) n").first()
    assert tuple(r) == ("creme fin", "lisbeth-imbo", "de x, y", "") and text.fold_text("Crème ﬁn!") == "creme fin"
    with pytest.raises(Exception):
        spark.sql("SELECT fold(1, 2)").collect()
