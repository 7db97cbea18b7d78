"""Presentation values as Column expressions: dates, numbers, durations, paths, snippets, XML and JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import text

# Fixed values.
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
SNIPPET = 155


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_name(n: Column) -> Column:
    """Dutch name of a month from 1 to 12."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), n)


def nl_date(c: Column | str) -> Column:
    """ISO text or epoch seconds (as text) as `27 juni 2026`; '' for what is neither."""
    c = _c(c).cast("string")
    stamp = F.when(c.rlike(r"^-?\d{9,}(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double"))).otherwise(F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit("+00:00"))))
    day = F.to_date(stamp)
    return F.coalesce(F.concat_ws(" ", F.dayofmonth(day), F.when(day.isNotNull(), month_name(F.month(day))), F.year(day)), F.lit(""))


def rounded(c: Column | str) -> Column:
    """65530 as `65.000+`, numbers under 1000 as they are."""
    c = _c(c)
    return F.when(c >= 1000, F.concat(F.floor(c / 1000).cast("string"), F.lit(".000+"))).otherwise(c.cast("string"))


def nl_number(c: Column | str) -> Column:
    """9803 as `9.803`."""
    return F.translate(F.format_number(_c(c), 0), ",", ".")


def snippet(c: Column | str, limit: int = SNIPPET) -> Column:
    """Text in one line without outer quotes, cut at a word with an ellipsis."""
    flat = F.btrim(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " ")), F.lit("\"“”'"))
    head = F.left(flat, F.lit(limit))
    at_word = F.rtrim(F.regexp_extract(head, "(?s)^(.*) ", 1), F.lit(" ,;:-–—"))
    cut = F.when(F.contains(head, F.lit(" ")), at_word).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def minutes(c: Column | str) -> Column:
    """Minutes of `3:17:19` or `9 uur 1 minuut`; null for other texts."""
    s = F.trim(_c(c).cast("string"))
    clock, spoken = r"^(\d+):([0-5]\d)(?::[0-5]\d)?$", r"(?i)^(?:(\d+)\s*uur)?(?:\D*?(\d+)\s*minu)?"
    n = lambda p, i: F.coalesce(F.regexp_extract(s, p, i).try_cast("int"), F.lit(0))
    said = (F.regexp_extract(s, spoken, 1) != "") | (F.regexp_extract(s, spoken, 2) != "")
    return F.when(s.rlike(clock), n(clock, 1) * 60 + n(clock, 2)).when(said, n(spoken, 1) * 60 + n(spoken, 2))


def short_duration(c: Column | str) -> Column:
    """`3 u 17 min` for either spelling of a duration; other texts as they are, '' for null."""
    m = minutes(c)
    hours, rest = F.floor(m / 60).cast("string"), (m % 60).cast("string")
    short = F.when((m >= 60) & (m % 60 > 0), F.concat(hours, F.lit(" u "), rest, F.lit(" min"))).when(m >= 60, F.concat(hours, F.lit(" u"))).otherwise(F.concat(rest, F.lit(" min")))
    return F.when(m.isNotNull(), short).otherwise(F.coalesce(F.trim(_c(c).cast("string")), F.lit("")))


def cover_width(c: Column | str, width: int = 400) -> Column:
    """A cover address with the width asked for; '' for null."""
    c = F.coalesce(_c(c), F.lit(""))
    added = F.concat(c, F.when(F.contains(c, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"width={width}"))
    return F.when(c == "", c).when(F.contains(c, F.lit("width=")), F.regexp_replace(c, r"width=\d+", f"width={width}")).otherwise(added)


def slug_words(c: Column | str) -> Column:
    """A path segment as a search phrase."""
    return F.trim(F.regexp_replace(F.try_url_decode(F.replace(_c(c), F.lit("+"), F.lit("%2B"))), r"[\s\-_]+", " "))


def is_wordy(c: Column | str) -> Column:
    """Whether a path segment is a slug of words."""
    return _c(c).rlike("(?i)^[a-z][a-z0-9]{2,}(?:-[a-z0-9]+)*$")


def quoted(c: Column | str) -> Column:
    """Percent-encoding with spaces as %20 and ~ kept."""
    return F.replace(F.replace(F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def path(kind: str, name: Column | str) -> Column:
    """/kind/slug, or the encoded name where nothing folds. kind: auteur, reeks, genre or uitgever."""
    return F.concat(F.lit(f"/{kind}/"), F.coalesce(F.nullif(text.slugify(name), F.lit("")), quoted(name)))


def book_path(slug: Column | str, work_id: Column | str) -> Column:
    """/boek/slug--id, or /boek/id without a slug."""
    slug = F.coalesce(_c(slug), F.lit(""))
    return F.concat(F.lit("/boek/"), F.when(slug != "", F.concat(slug, F.lit("--"))).otherwise(F.lit("")), _c(work_id))


def id_of_path(c: Column | str) -> Column:
    """The id at the end of a book path: what follows the last two dashes."""
    return F.regexp_extract(_c(c), r"(?s)^(?:/boek/)?(?:.*--)?(.*)$", 1)


def xml_escape(c: Column | str) -> Column:
    """Text safe in XML."""
    return F.replace(F.replace(F.replace(_c(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def w3c(c: Column | str) -> Column:
    """Epoch seconds as a W3C time in UTC; '' for null or 0."""
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(_c(c)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.coalesce(_c(c), F.lit(0)) == 0, "").otherwise(stamp)


def sitemap_entry(origin: str, c: Column | str) -> Column:
    """One url element of a sitemap."""
    return F.concat(F.lit(f"<url><loc>{origin}"), xml_escape(c), F.lit("</loc></url>"))


def breadcrumbs(origin: str, *trail: tuple[Column, Column]) -> Column:
    """JSON-LD breadcrumb list, home first; a crumb with an empty path has no item."""
    crumb = lambda i, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), name.alias("name"), item.alias("item"))
    items = [crumb(1, F.lit("Home"), F.lit(f"{origin}/"))]
    items += [crumb(i, label, F.when(way != "", F.concat(F.lit(origin), way))) for i, (label, way) in enumerate(trail, 2)]
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.array(*items).alias("itemListElement")))


def book_json_ld(**fields: Column) -> Column:
    """JSON-LD of a book; null fields drop."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Book").alias("@type"), *[c.alias(n) for n, c in fields.items()]))
