import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import display, params, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


def many(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], f"i int, x {kind}")
    got = {r["i"]: r["y"] for r in df.select("i", f("x").alias("y")).collect()}
    for i, (value, want) in enumerate(cases):
        assert got[i] == want, (value, got[i], want)


def test_fold_equals_the_driver_side_fold(spark):
    values = [None, "", "Crème Brûlée!", "ﬁne ½ ² Ａbc", "İstanbul", "Strøm", "Αθήνα", "áb", "Ǆungla", "x" * 5000]
    many(spark, [(v, text.fold_text(v)) for v in values], text.fold)


def test_surname_key(spark):
    many(spark, [("Alexander Klöpping", "klopping"), ("Bob de Wit", "wit"), ("Buren, van", "buren"), ("James Burn sr.", "burn"), ("Mariela SR", "sr"), ("Wim Kloppenburg (red.)", "kloppenburg"), ("Conan O'Brien", "obrien"), ("Jo Røyne", "royne"), ("Wolde, van 't", "wolde"), ("boeken.nl", "boeken"), ("Jan Jansen e.a.", "jansen"), ("Ludique le Vert", "vert"), (None, ""), ("van", "van")], text.surname_key)


def test_publisher_and_author_keys(spark):
    many(spark, [("De Correspondent, Amsterdam", "de correspondent, amsterdam"), ("de  Correspondent, [Amsterdam].", "de correspondent, amsterdam"), (None, "")], text.publisher_key)
    many(spark, [("Uitgeverij de correspondent BV", "De Correspondent, Amsterdam"), ("Anders", "Anders"), (None, None), ("", "")], text.canonical_publisher)
    many(spark, [("Bernlef", "J. Bernlef"), ("Anna Vrij", "Anna Vrij"), (None, None)], text.canonical_author)
    many(spark, [("A | B;  C, |A", ["A", "B", "C"]), (None, []), ("Buren, van", ["Buren, van"])], text.split_authors)
    many(spark, [("Αθήνα", "\0Αθήνα"), ("Bob", "bob")], text.author_key)


def test_series_and_noise(spark):
    s = lambda c: F.to_json(text.detect_series(c))
    many(spark, [("Samen: deel 2", '{"series":"Samen","series_no":2}'), ("Iets (De Reeks, deel 3)", '{"series":"De Reeks","series_no":3}'), ("Deel 4 van de serie Foo", '{"series":"Foo","series_no":4}'), ("1984", "{}"), ("Catch-22", "{}"), (None, "{}")], s)
    many(spark, [("De adoptie - luisterboek", "De adoptie"), ("Luisterboek", "Luisterboek"), ("Boek (e-book)", "Boek"), ("Het luisterboek van opa", "Het luisterboek van opa"), ("X [digitaal luisterboek]", "X"), (None, "")], text.strip_format_noise)


def test_languages_letters_slugs(spark):
    many(spark, [("Nederlands", "nl"), ("oekraiens", "uk"), ("Fictie", None), ("Schots", None), (None, None)], text.language_code)
    many(spark, [("Schots", "Schots"), ("Fictie", None)], text.valid_language)
    many(spark, [("klopping", "K"), ("9", "overig"), ("", "overig"), (None, "overig")], text.letter)
    many(spark, [("een-heel-lange-slug", "een-heel"), ("kort", "kort"), ("zonderstreepjes", "zonderstre")], lambda c: text.cap_slug(F.col(c), 10))


def test_display(spark):
    many(spark, [("2026-06-27T10:00:00", "27 juni 2026"), ("2026-06-27", "27 juni 2026"), ("junk", ""), (None, "")], display.nl_date)
    many(spark, [("3:17:19", "3 u 17 min"), ("9 uur 1 minuut", "9 u 1 min"), ("45 minuten", "45 min"), ("2 uur", "2 u"), ("lang", "lang"), (None, "")], display.short_duration)
    many(spark, [(65530, "65.000+"), (999, "999")], display.rounded, "int")
    many(spark, [(9803, "9.803"), (12, "12")], display.nl_number, "int")
    many(spark, [('  "Een  boek."\n', "Een boek."), ("woord " * 40, ("woord " * 40)[:155].rsplit(" ", 1)[0] + "…"), (None, "")], display.snippet)
    many(spark, [("u?width=320&x=1", "u?width=400&x=1"), ("u", "u?width=400"), ("u?a=1", "u?a=1&width=400"), (None, "")], display.cover_width)
    many(spark, [("annie-mg_schmidt", "annie mg schmidt"), ("a%20b", "a b")], display.slug_words)
    many(spark, [("Lisbeth Imbo", "/auteur/lisbeth-imbo"), ("Αθήνα", "/auteur/%CE%91%CE%B8%CE%AE%CE%BD%CE%B1")], lambda c: display.path("auteur", c))
    many(spark, [("/boek/de-x--anna--001", "001"), ("/boek/001", "001")], display.id_of_path)
    many(spark, [(0, ""), (86400, "1970-01-02T00:00:00Z")], display.w3c, "long")


def test_params():
    assert [params.parse_year(x) for x in ("", " 1999 ", "x", "123456", None, "-5")] == [None, 1999, None, None, None, -5]
    assert [params.clamp(x, 7, 20) for x in (5, "x", -3, 99, None)] == [5, 7, 1, 20, 7]
    assert [params.parse_page(x) for x in ("3", "0", "x", "5000")] == [3, 1, 1, 100]
    assert params.per_page("48") == 48 and params.per_page("13") == 24
    assert params.terms("Café-noir één_twee") == ["cafe", "noir", "een", "twee"] and len(params.terms("w " * 50)) == 12 and params.terms("!!!") == []
    assert params.distinct(["a", "", "b", "a"]) == ("a", "b")
    assert params.url_with({"q": "x", "g": ["a", "b"], "e": ""}, g=["b"]) == "?q=x&g=b"
    assert params.url_without({"g": ["a", "b"]}, "g", "a") == "?g=b&pagina=1"


def test_dates_follow_iso_weeks(spark):
    from shelfspark.sources import lists

    many(spark, [("Week 26 - 2026", "week 26 · 22 t/m 28 juni 2026"), ("2026 week 27", "week 27 · 29 juni t/m 5 juli 2026"), ("Week 1 - 2026", "week 1 · 29 december 2025 t/m 4 januari 2026"), ("Week 53 - 2025", None), ("niets", None)], lists.week_range)
    assert datetime.date.fromisocalendar(2026, 26, 1).day == 22


@pytest.mark.parametrize("sort", ["added", "year_desc", "year_asc", "title", "nonsense"])
def test_orders_are_total(spark, sort):
    df = spark.createDataFrame([("1", "b", 1, None), ("2", "A", None, 3), ("3", "b", 1, None)], "work_id string, title string, year int, added_rank int")
    got = [r["work_id"] for r in params.ordered(df, sort).collect()]
    assert got == {"added": ["2", "1", "3"], "year_desc": ["1", "3", "2"], "year_asc": ["2", "1", "3"]}.get(sort, ["2", "1", "3"])
