import pytest
from pyspark.sql import functions as F

from shelfspark.queries import page_queries
from shelfspark.sources import files, lists, pages, raw_store
from shelfspark.streaming import ingest
from tests.sample import rows

DETAIL = """<html><head><title>De Titel - Anna Vrij | e-book | de online Bibliotheek</title><link rel="canonical" href="https://x/catalogus/41672x/de-titel?a=1">
<meta name="description" content=" Een verhaal. "></head><body><img class="representative" src="https://c/PPN:41672x"><span class="title">De  Titel</span>
<span class="creator">Anna Vrij</span><span class="creator">Bob</span><p class="devicetypes"><span class="app">app</span></p>
<dl><dt>Taal:</dt><dd>Nederlands</dd><dt>Verschenen</dt><dd>maart 2020</dd><dt>Aantal pagina's</dt><dd>1.234</dd><dt>Serie</dt><dd>De Reeks (7)</dd>
<dt>Onderwerpen: Jeugd</dt><dd><a href="?onderwerpJeugd=2.6">Dieren</a> | <a href="?onderwerpJeugd=2.0">Natuur</a></dd><dt>Onderwerpen</dt><dd>hond | kat · hond</dd>
<dt>Ook beschikbaar als</dt><dd><a href="/catalogus/999/x">Luisterboek</a></dd><dt>Inhoud</dt><dd>Non-fictie</dd><dt>Speelduur</dt><dd>3 uur</dd><dt>Speelduur</dt><dd>3:10:00</dd></dl></body></html>"""
LISTING = """<p class="totalresults">Resultaat 1 - 20 <span>(van 3.124)</span></p><ul class="rich-list"><li><a class="image-link" href="/catalogus/12/slug-a"><img class="cover" src="c.jpg"></a>
<span class="title">Titel A</span><span class="creator">Anna | </span><p class="additional medium ebook">e-book</p><p class="additional">Nederlands | 47 pagina's (ePub3, 9,8 MB) | Querido | 2020</p></li>
<li><a href="/catalogus/13/slug-b">b</a><p class="additional medium">luisterboek</p><p class="additional">Fictie</p><p class="additional">6 uur 54 minuten (596 MB) | Uitgever X</p></li></ul><a href="zoekresultaten.catalogus.7.html">7</a>"""


def test_detail_page():
    r = pages.parse_detail(DETAIL)
    assert (r["ppn"], r["slug"], r["title"], r["author"], r["format"], r["summary"]) == ("41672x", "de-titel", "De Titel", "Anna Vrij ; Bob", "ebook", "Een verhaal.")
    assert (r["ereader"], r["year"], r["pages"], r["series"], r["series_no"], r["category"], r["duration"]) == (0, 2020, 1234, "De Reeks", 7, "nonfictie", "3:10:00")
    assert r["genres"] == [{"code": "2.6", "name": "Dieren"}, {"code": "2.0", "name": "Natuur"}] and r["keywords"] == ["hond", "kat"] and r["audience"] == "Jeugd" and r["related_ppns"] == ["999"]
    assert pages.parse_detail("<p>niets") is None and pages.parse_detail("", "5")["cover_url"] == pages.COVER.format("5")


def test_listing_page():
    a, b = pages.parse_listing(LISTING)
    assert (a["ppn"], a["slug"], a["format"], a["language"], a["pages"], a["features"], a["size"], a["publisher"], a["year"], a["author"]) == ("12", "slug-a", "ebook", "Nederlands", 47, "ePub3", "9,8 MB", "Querido", 2020, "Anna")
    assert (b["format"], b["category"], b["duration"], b["size"]) == ("audiobook", "fictie", "6 uur 54 minuten", "596 MB")
    assert pages.max_page(LISTING) == 7 and pages.total_results(LISTING) == 3124 and pages.total_results("x") is None
    with pytest.raises(pages.NotAResultsPage):
        pages.parse_listing("<h1>Onderhoud</h1>")


def test_pages_as_tables(spark):
    df = spark.createDataFrame([("1", DETAIL), (None, DETAIL), ("3", None)], "ppn string, html string")
    assert rows(pages.parse_details(df), "ppn", "year") == [("1", 2020), ("41672x", 2020)]
    df = spark.createDataFrame([("p1", LISTING), ("p2", "<h1>x"), ("p3", None)], "page string, html string")
    assert rows(pages.parse_listings(df).select("page", "ppn", "is_results").na.fill("")) == [("p1", "12", True), ("p1", "13", True), ("p2", "", False), ("p3", "", False)]


def test_lists(spark):
    card = '<div class="card__position"> <b>{}</b></div><h3 class="card__title" title="{}"></h3><div class="card__author"><a href="#"> {} </a></div> ISBN 9789012345678'
    html = card.format(2, "B &amp; C", "Bob") + card.format(1, "A", "Anna") + card.format(2, "Dubbel", "X")
    got = lists.bestseller_cards(spark.createDataFrame([("l", html)], "list string, html string"))
    assert [(r["position"], r["title"], r["author"], r["isbn"]) for r in got.collect()] == [(1, "A", "Anna", "9789012345678"), (2, "B & C", "Bob", "9789012345678")]
    api = '{"results":{"lists":[{"list_name_encoded":"fic","display_name":"Fiction","books":[{"rank":1,"title":"IT\'S A TITLE","author":"A","primary_isbn10":"1"}]},{"list_name_encoded":"leeg","books":[]}]}}'
    assert rows(lists.api_overview(spark.createDataFrame([(api,)], "json string")), "list", "position", "title", "isbn") == [("nyt-fic", 1, "It'S A Title", "1")]
    wiki = "== Winnaars ==\n=== 2014 ===\n* [[Anna Vrij]] – ''[[De titel (roman)|De titel]]''\n* [[Bob]] – ''Tweede''\n=== 2015 ===\n| [[Cara]] || ''Derde''\n== Genomineerden ==\n* 2016: [[Dirk]] – ''Vierde''\n== Trivia ==\n* 2001 [[Eva]] – ''Geen''"
    assert rows(lists.prize_pages(spark.createDataFrame([("p", wiki)], "list string, wikitext string")), "position", "year", "title", "author", "won") == [(1, 2016, "Vierde", "Dirk", 0), (2, 2015, "Derde", "Cara", 1), (3, 2014, "De titel", "Anna Vrij", 1), (4, 2014, "Tweede", "Bob", 0)]
    new = lambda n: lambda: spark.range(n)

    def broken():
        raise OSError("unreachable")

    out, kept = lists.update({"a": new(3), "b": new(0), "c": broken}, {"b": spark.range(9)}, 2)
    assert out["a"].count() == 3 and out["b"].count() == 9 and kept == ["b", "c"]


def test_prize_years_are_not_read_from_names(spark):
    wiki = "== 1930 ==\n* ''Boek 1950'' by [[Naam 1950]]\n=== Genomineerd ===\n* ''Ook 2001'' by [[Twee 2001|2001]]\n== Winnaars ==\n* [[2014]]: ''1984'' – [[George]]\n| ''Zes'' || [[Bob]] || [[2016 in boeken]]"
    got = lists.prize_pages(spark.createDataFrame([("p", wiki)], "list string, wikitext string"))
    assert rows(got, "year", "title", "author", "won") == [(1930, "Boek 1950", "Naam 1950", 1), (1930, "Ook 2001", "Twee 2001", 0), (2014, "1984", "George", 1), (2016, "Zes", "Bob", 1)]


def test_headings_of_one_prize_year_have_a_winner_each(spark):
    wiki = "== 2014 ==\n* ''Een'' by [[A]]\n* ''Twee'' by [[B]]\n=== Genomineerd ===\n* ''Drie'' by [[C]]\n== 2014 ==\n* ''Vier'' by [[D]]\n=== Shortlist 2014 ===\n* ''Vijf'' by [[E]]\n=== Slot ===\n* ''Zes'' by [[F]]"
    got = lists.prize_pages(spark.createDataFrame([("p", wiki)], "list string, wikitext string"))
    assert rows(got, "position", "title", "won") == [(1, "Een", 1), (2, "Twee", 0), (3, "Drie", 0), (4, "Vier", 1), (5, "Vijf", 0), (6, "Zes", 0)]


def test_overviews_of_a_large_source_are_many_texts(spark, tmp_path):
    docs = spark.range(0, 5000, 2).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src' AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert page_queries._overviews(spark, str(tmp_path)).agg(F.max(F.length("json"))).first()[0] < 120_000
    assert sorted(r["position"] for r in page_queries.overview(spark, str(tmp_path)).collect()) == list(range(0, 5000, 2))


def test_pair_files(spark):
    texts = spark.createDataFrame([("https://x/catalogus/1x/a?b\n\n2, b-slug\nbad,c",), ('[{"ppn":"3","slug":"c"},{"url":"/catalogus/4/d"},{"x":1}]',), ('{"ppn":"5","slug":"e"}',)], "value string")
    assert rows(files.pairs(texts)) == [("1x", "a"), ("2", "b-slug"), ("3", "c"), ("4", "d"), ("5", "e")]


def test_json_source_with_default(spark, tmp_path):
    assert files.read_json(spark, f"{tmp_path}/none.json", "a int").count() == 0
    files.write_json(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/x.json")
    assert rows(files.read_json(spark, f"{tmp_path}/x.json", "a int")) == [(1,)]


def test_store_upsert_tombstone_and_return(spark):
    new = lambda *r: spark.createDataFrame(list(r), "ppn string, record string")
    s = raw_store.put(raw_store.empty(spark), new(("1", "a"), ("2", "b"), ("3", "c")), "T1")
    s = raw_store.put(s, new(("1", "a"), ("2", "B")), "T2")
    assert rows(s, "ppn", "record", "first_seen", "updated_at") == [("1", "a", "T1", None), ("2", "B", "T1", "T2"), ("3", "c", "T1", None)]
    seen = spark.createDataFrame([("1",)], "ppn string")
    s, done = raw_store.reconcile(s, seen, "T3")
    s, _ = raw_store.reconcile(s, seen, "T4")
    assert done and rows(s, "ppn", "removed_at") == [("1", None), ("2", "T3"), ("3", "T3")]
    s = raw_store.put(s, new(("2", "B"),), "T5", is_live=True)
    assert rows(s, "ppn", "removed_at") == [("1", None), ("2", None), ("3", "T3")]
    s = raw_store.put_pages(s, spark.createDataFrame([("1", "<p>")], "ppn string, html string"), "T6")
    assert rows(raw_store.pages(s)) == [("1", "<p>")] and tuple(raw_store.counts(s).first()) == (3, 1)


def test_removal_gate_refuses_a_hole(spark):
    s = raw_store.put(raw_store.empty(spark), spark.range(1000).selectExpr("cast(id as string) ppn", "'x' record"), "T1")
    _, done = raw_store.reconcile(s, spark.range(940).selectExpr("cast(id as string) ppn"), "T2")
    assert not done
    after, done = raw_store.reconcile(s, spark.range(960).selectExpr("cast(id as string) ppn"), "T2")
    assert done and after.where("removed_at = 'T2'").count() == 40


def test_overlay_keeps_what_new_does_not_say(spark):
    base = spark.createDataFrame([("1", "isbn", 5, ["a"])], "ppn string, isbn string, n int, tags array<string>")
    new = spark.createDataFrame([("1", "", 0, []), ("2", "x", 1, ["b"])], "ppn string, isbn string, n int, tags array<string>")
    assert rows(raw_store.overlay(base, new), "ppn", "isbn", "n") == [("1", "isbn", 5), ("2", "x", 1)]


def test_completeness_is_strict_about_removals(spark):
    expected = spark.createDataFrame([("a", "f"), ("b", "f")], "cell string, format string")
    cells = lambda *r: spark.createDataFrame(list(r), "cell string, got int, claimed int")
    check = lambda c, f=None: tuple(raw_store.completeness(c, expected, f).first())
    assert check(cells(("a", 10, 10), ("b", 5, None))) == (True, True)
    assert check(cells(("a", 9, 10), ("b", 5, 5))) == (True, False)
    assert check(cells(("a", 900, 1000), ("b", 5, 5))) == (False, False)
    assert check(cells(("a", 10, 10))) == (False, False)
    assert check(cells(("a", 10, 10), ("b", 5, 5)), spark.createDataFrame([("f", 100)], "format string, claimed int")) == (False, False)


def test_streak_and_recency(spark):
    feed = spark.createDataFrame([(i, str(i % 4), i in (0, 2)) for i in range(8)], "position int, ppn string, c boolean")
    assert [r["position"] for r in raw_store.streak_cut(feed, F.col("c"), 3).orderBy("position").collect()] == [0, 1, 2, 3, 4, 5]
    assert raw_store.streak_cut(feed, F.col("c"), 30).count() == 8
    assert rows(raw_store.first_appearance(feed)) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]


def test_streaming_upsert_equals_the_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows_ = lambda n: spark.createDataFrame([(str(k), f"v{n}{k}", n * 10 + k) for k in range(3)] + [("0", f"w{n}", n * 10 + 5)], "ppn string, record string, seq int")
    rows_(1).coalesce(1).write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema("ppn string, record string, seq int").option("recursiveFileLookup", True).parquet(src)
    run = lambda: ingest.upsert_stream(stream(), f"file://{tmp_path}/store", f"{tmp_path}/ck", now=lambda n: f"T{n}").awaitTermination()
    run()
    rows_(2).where("ppn < 2").coalesce(1).write.parquet(f"{src}/b")
    run()
    got = rows(ingest.current_store(spark, f"file://{tmp_path}/store"), "ppn", "record", "first_seen", "updated_at")
    assert got == [("0", "w2", "T0", "T1"), ("1", "v21", "T0", "T1"), ("2", "v12", "T0", None)]


def test_streaming_windows_with_watermark(spark, tmp_path):
    src = f"{tmp_path}/ev"
    e = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a", 1.0), (1, "2024-01-01 02:00:00", "a", 2.0), (2, "2024-01-05 01:00:00", "a", 4.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["value"]) for r in spark.table("tumbled").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]
