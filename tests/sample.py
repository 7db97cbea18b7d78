"""Nine editions of five works, one list."""

from pyspark.sql import functions as F

SCHEMA = "ppn string, title string, author string, format string, language string, publisher string, isbn string, year int, series string, series_no int, subjects array<string>, ereader int, related_ppns array<string>, summary string, keywords string, audience string, added_rank int"


def editions(spark):
    lit, thr, fam = ["Literatuur & Romans"], ["Spanning & Thrillers"], ["Gezin & Gezondheid"]
    rows = [
        ("001", "De Ontdekking", "Anna Vrij", "ebook", "Nederlands", "Querido, Amsterdam", "9780000000001", 2020, None, None, lit, 1, None, "Een reis naar España.", None, None, 3),
        ("002", "De Ontdekking", "Anna Vrij", "audiobook", "Nederlands", "Querido, Amsterdam", None, 2021, None, None, lit, None, None, "Kort.", None, None, 1),
        ("003", "Thriller in de Nacht", "Bob de Wit | Cara Licht", "ebook", "Engels", "Spanning BV", None, 2015, None, None, thr, 0, None, "Nacht.", None, None, None),
        ("004", "Het Mysterie: deel 2", "Bob de Wit", "ebook", "Nederlands", "Spanning BV", None, 2018, "Het Mysterie", 2, thr, None, None, None, None, None, None),
        ("005", "Koken met Liefde", "Dirk Kok", "ebook", "Nederlands", "Keuken Pers", None, 2022, None, None, fam, 1, None, None, "pasta, italiaans", None, None),
        ("006", "Poesía Española", "Elena Sol", "ebook", "Spaans", "Sol Editorial", None, 2019, None, None, lit, None, None, None, None, None, None),
        ("007", "De Ontdekking", "Anna Vrij", "audiobook", "Nederlands", "Querido, Amsterdam", None, 2023, None, None, lit, None, None, "De walvisexpeditie van Anna en een lange tekst.", None, None, None),
        ("008", "Koken met Liefde - luisterboek", "Dirk Kok", "audiobook", "Nederlands", "Keuken Pers", None, 2022, None, None, fam, None, None, None, None, None, None),
        ("009", "Het grote mysterie, tweede deel", "Bob De Wit", "audiobook", "Nederlands", "Spanning BV", None, 2019, None, None, thr, None, ["004"], None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


WORK_OF = {"001": "001", "002": "001", "007": "001", "003": "003", "004": "004", "009": "004", "005": "005", "008": "005", "006": "006"}


def list_items(spark):
    rows = [("test-top", 1, "De ontdekking", "A. Vrij", None), ("test-top", 2, "Onbekend", "Niemand", None), ("test-top", 3, "Thriller in de nacht", "Bob de Wit", None), ("test-top", 4, "Iets", "Iemand", "978-0000000001")]
    return spark.createDataFrame(rows, "list string, position int, title string, author string, isbn string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(tuple(r) for r in df.collect())


__all__ = ["F", "WORK_OF", "editions", "list_items", "rows"]
