"""Text normalisation as Column expressions: no Python runs on the executors."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Words and names that results depend on; folded spellings where noted.
PARTICLES = ("van", "de", "der", "den", "het", "ten", "ter", "te", "op", "aan", "in", "'t", "du", "des", "del", "della", "la", "le", "di", "da", "dos", "von", "zu", "af", "t")
NAME_SUFFIXES = (("e", "v", "a"), ("e", "a"), ("c", "s"), ("et", "al"), ("jr",), ("sr",))
TRANSLITERATED = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ß": "ss", "ı": "i"}
PUBLISHER_ALIASES = (("De Correspondent, Amsterdam", "correspondent"), ("Das Mag, Amsterdam", "das mag"), ("Prometheus Bert Bakker, Amsterdam", "bert bakker"))
AUTHOR_ALIASES = {"bernlef": "J. Bernlef"}
FORMAT_MARKERS = (r"luisterboek \(digitaal\)", "digitaal luisterboek", "gesproken versie", "luisterboek", "audioboek", "digitaal", "e-book", "epub3", "epub2", "ebook", "epub", "mp3")
LANGUAGE_CODES = {
    "Nederlands": "nl", "Engels": "en", "Duits": "de", "Frans": "fr", "Spaans": "es", "Italiaans": "it", "Portugees": "pt", "Latijn": "la",
    "Grieks": "el", "Nieuwgrieks": "el", "Russisch": "ru", "Pools": "pl", "Tsjechisch": "cs", "Slowaaks": "sk", "Hongaars": "hu", "Roemeens": "ro",
    "Bulgaars": "bg", "Servisch": "sr", "Kroatisch": "hr", "Bosnisch": "bs", "Sloveens": "sl", "Oekraïens": "uk", "Wit-Russisch": "be",
    "Macedonisch": "mk", "Albanees": "sq", "Zweeds": "sv", "Noors": "no", "Deens": "da", "Fins": "fi", "IJslands": "is", "Ests": "et", "Lets": "lv",
    "Litouws": "lt", "Turks": "tr", "Arabisch": "ar", "Hebreeuws": "he", "Jiddisch": "yi", "Perzisch": "fa", "Koerdisch": "ku", "Chinees": "zh",
    "Japans": "ja", "Koreaans": "ko", "Hindi": "hi", "Urdu": "ur", "Bengaals": "bn", "Indonesisch": "id", "Maleis": "ms", "Thais": "th",
    "Vietnamees": "vi", "Afrikaans": "af", "Swahili": "sw", "Armeens": "hy", "Georgisch": "ka", "Catalaans": "ca", "Galicisch": "gl", "Baskisch": "eu",
    "Iers": "ga", "Welsh": "cy", "Bretons": "br", "Papiaments": "pap", "Fries": "fy", "Westerlauwers Fries": "fy", "Limburgs": "li",
    "Esperanto": "eo", "Sanskriet": "sa", "meerdere talen": "mul",
}
#: Languages without one code of their own.
OTHER_LANGUAGES = ("Schots",)
OTHER_LETTER = "overig"
# ------------------------------------------------------------ end fixed values


def fold_text(value: str | None) -> str:
    """Driver-side fold, for literals such as search terms and filter values."""
    kept = (c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", "".join(kept).lower()).strip()


@lru_cache(1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one ASCII letter or digit and those letters, with marks to delete last; and those that fold to more."""
    single, marks, several = {}, [], {}
    for i in range(128, min(0x10000, sys.maxunicode)):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain != c and re.search("[a-z0-9]", plain):
            if len(plain) == 1:
                single[c] = plain
            else:
                several[c] = plain
    return "".join(single) + "".join(marks), "".join(single.values()), several


def literal_map(pairs: dict[str, str]) -> Column:
    """A map constant, folded by the optimizer to one literal however many pairs there are."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


def several_class() -> str:
    """A pattern for the characters that fold to more than one, as ranges of neighbours."""
    points = sorted(map(ord, _fold_tables()[2]))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, runs of anything but a-z and 0-9 as single spaces; '' for null.

    Rows of ASCII alone (as many bytes as characters) need no translation.
    """
    c = F.col(c) if isinstance(c, str) else c
    source, target, several = _fold_tables()
    spelled = literal_map(several)
    wide = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(spelled, x), x)), "")
    ascii_only = F.octet_length(c) == F.length(c)
    plain = F.when(ascii_only, c).when(c.rlike(several_class()), F.translate(wide, source, target)).otherwise(F.translate(c, source, target))
    return F.coalesce(F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " ")), F.lit(""))


def slugify(c: Column | str) -> Column:
    """fold with dashes for spaces."""
    return F.replace(fold(c), F.lit(" "), F.lit("-"))


def split_authors(c: Column | str) -> Column:
    """Names between | or ;, without blanks and repeats, in order. A comma does not split."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*[|;]\s*"), lambda x: F.btrim(x, F.lit(" \t,")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def publisher_key(c: Column | str) -> Column:
    """Lower case without square brackets, single spaces, no outer spaces, dots or commas; '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.btrim(F.regexp_replace(F.translate(F.lower(c), "[]", ""), r"\s+", " "), F.lit(" .,")), F.lit(""))


def canonical_publisher(c: Column | str, fallback: Column | None = None) -> Column:
    """The curated name whose pattern the fold contains, first match first; else fallback; else the value."""
    c = F.col(c) if isinstance(c, str) else c
    folded, out = fold(c), F.coalesce(fallback, c) if fallback is not None else c
    for name, pattern in reversed(PUBLISHER_ALIASES):
        out = F.when(F.contains(folded, F.lit(pattern)), F.lit(name)).otherwise(out)
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(out)


def canonical_author(c: Column | str) -> Column:
    """The curated spelling of a known variant, else the value."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for variant, name in AUTHOR_ALIASES.items():
        out = F.when(fold(c) == variant, F.lit(name)).otherwise(out)
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(out)


def surname_key(c: Column | str) -> Column:
    """Folded surname: the last token once roles, web domains, generation suffixes and particles are off; '' for null."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"(?i)\.(?:nl|com|be|org|net|eu|de)\s*$", "")
    bare = F.regexp_replace(bare, "[’'`]", "")
    for letter, plain in TRANSLITERATED.items():
        bare = F.replace(bare, F.lit(letter), F.lit(plain))
    parts = F.filter(F.split(fold(bare), " "), lambda x: x != "")

    def step(now: Column, _: Column) -> Column:
        n = F.size(now)
        out = F.when((n > 1) & F.element_at(now, -1).isin(*PARTICLES), F.slice(now, 1, n - 1)).otherwise(now)
        for suffix in reversed(NAME_SUFFIXES):
            k = len(suffix)
            ends = F.concat(F.lit(" "), F.array_join(now, " ")).endswith(" " + " ".join(suffix))
            out = F.when((n - k >= 2) & ends, F.slice(now, 1, n - k)).otherwise(out)
        return F.when(n > 1, out).otherwise(now)

    return F.coalesce(F.try_element_at(F.aggregate(parts, parts, step), F.lit(-1)), F.lit(""))


def is_language(c: Column | str) -> Column:
    """Whether the fold is a known language name."""
    return fold(c).isin(*sorted({fold_text(x) for x in (*LANGUAGE_CODES, *OTHER_LANGUAGES)}))


def valid_language(c: Column | str) -> Column:
    """The value if it is a known language name, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_language(c), c)


def language_code(c: Column | str) -> Column:
    """BCP 47 code of a Dutch language name, else null."""
    codes = {fold_text(name): code for name, code in LANGUAGE_CODES.items()}
    return F.element_at(literal_map(codes), fold(c))


def match_key(title: Column | str, author: Column | str) -> Column:
    """Fold of the title, a bar, and the last token of the author's fold."""
    return F.concat(fold(title), F.lit("|"), F.element_at(F.split(fold(author), " "), -1))


_DEEL = (r"(?i)^(.+?)\s*[:\-–—]\s*deel\s*(\d+)\b", r"(?i)\(\s*([^()]+?)\s*[,;]?\s*deel\s*(\d+)\s*\)", r"(?i)\bdeel\s*(\d+)\s+van\s+(?:de\s+)?(?:reeks|serie)\s+([^.()]+)")


def detect_series(c: Column | str) -> Column:
    """struct(series, series_no) from an explicit part marker in a title; nulls without one."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    out = F.struct(F.lit(None).cast("string").alias("series"), F.lit(None).cast("int").alias("series_no"))
    for pattern, name, number in reversed([(_DEEL[0], 1, 2), (_DEEL[1], 1, 2), (_DEEL[2], 2, 1)]):
        found = F.struct(F.btrim(F.regexp_extract(c, pattern, name), F.lit(" :-,;")).alias("series"), F.regexp_extract(c, pattern, number).try_cast("int").alias("series_no"))
        out = F.when(c.rlike(pattern), found).otherwise(out)
    return out


def strip_format_noise(c: Column | str) -> Column:
    """The title without one trailing format marker, bracketed or after a dash; never emptied; '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    markers = "|".join(FORMAT_MARKERS)
    pattern = rf"(?i)\s*(?:[-–—:;]\s*)?(?:\(\s*(?:{markers})\s*\)|\[\s*(?:{markers})\s*\]|\b(?:{markers}))\s*$"
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, pattern, "")), F.lit("")), c, F.lit(""))


def author_key(c: Column | str) -> Column:
    """Identity of a person: the fold, or the exact name after a NUL where nothing folds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(fold(c) == "", F.concat(F.lit("\0"), c)).otherwise(fold(c))


def letter(c: Column | str) -> Column:
    """A-Z bucket of a sort key, or the catch-all."""
    first = F.upper(F.substring(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 1, 1))
    return F.when(first.between("A", "Z"), first).otherwise(F.lit(OTHER_LETTER))


def cap_slug(c: Column, limit: int) -> Column:
    """A slug cut to limit characters at a dash."""
    head = F.substring(c, 1, limit)
    at_dash = F.regexp_extract(head, "^(.+)-[^-]*$", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.btrim(F.coalesce(F.nullif(at_dash, F.lit("")), head), F.lit("-")))


def work_slug(title: Column | str, author: Column | str) -> Column:
    """Title slug and author slug with two dashes between; empty parts drop."""
    return F.array_join(F.filter(F.array(cap_slug(slugify(title), 60), cap_slug(slugify(author), 40)), lambda x: x != ""), "--")


def isbn_digits(c: Column | str) -> Column:
    """Digits only."""
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\D", "")


def nocase(c: Column | str) -> Column:
    """Sort key that ignores the case of ASCII letters only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())
