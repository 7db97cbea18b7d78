"""Ingest runs: cells of an enumeration, resume state, incremental sync, reparsing, full runs, refreshes.

Control flow is driver code over a bounded list of cells and pages; rows are DataFrames throughout.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources import pages, raw_store

PAGE_CAP, FIRST_YEAR, MAX_AGE_H = 500, 1400, 24.0
LISTING_FIELDS = ("slug", "url", "title", "author", "summary", "cover_url", "format", "category", "language", "pages", "features", "size", "duration", "publisher", "year")


@dataclass(frozen=True)
class Cell:
    """A query of the enumeration."""

    format: str
    language: str
    year: int | None = None
    sort: str = "title"

    @property
    def key(self) -> str:
        return f"{self.format}:{self.language}"


def split_cell(cell: Cell, this_year: int) -> list[Cell]:
    """What covers a cell that has more pages than can be asked for: each year, and the other sort order."""
    return [*(Cell(cell.format, cell.language, y) for y in range(this_year + 2, FIRST_YEAR - 1, -1)), Cell(cell.format, cell.language, None, "maker")]


@dataclass
class Walk:
    """What a walk over cells has found: rows by key, cells with counts, whether cells were skipped."""

    rows: dict[str, dict] = field(default_factory=dict)
    cells: list[tuple[str, str, int, int | None]] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)


def walk_cells(cells: Iterable[Cell], fetch: Callable[[Cell, int], tuple[list[dict], int | None]], done: set[str], this_year: int, cap: int = PAGE_CAP, on_done: Callable[[set[str]], None] = lambda done: None) -> Walk:
    """Page through cells; rows met before are left out. fetch gives a page's rows and the claimed total.

    Cells in done are skipped, unless done covers all: that is the state of a finished run. A cell
    that fails stays open for the next run.
    """
    cells = list(cells)
    if {c.key for c in cells} <= done:
        done.difference_update(c.key for c in cells)
        on_done(done)
    out = Walk()

    def paged(cell: Cell) -> tuple[int, int | None]:
        total = None
        for n in range(1, cap + 1):
            rows, claimed = fetch(cell, n)
            total = claimed if n == 1 else total
            if not rows:
                return n - 1, total
            for r in rows:
                out.rows.setdefault(r["ppn"], r)
        return cap, total

    for cell in cells:
        if cell.key in done:
            continue
        before = len(out.rows)
        try:
            last, total = paged(cell)
            if last >= cap:
                for part in split_cell(cell, this_year):
                    paged(part)
        except (OSError, pages.NotAResultsPage):
            out.failed.append(cell.key)
            continue
        out.cells.append((cell.key, cell.format, len(out.rows) - before, total))
        done.add(cell.key)
        on_done(done)
    return out


def load_done(spark: SparkSession, path: str, now: float, max_age_h: float = MAX_AGE_H) -> set[str]:
    """Cells that an interrupted run has finished; a state older than max_age_h is that of a dead run."""
    try:
        rows = spark.read.schema("cell string, at double").json(path).collect()  # one row a cell
    except AnalysisException:
        return set()
    return {r["cell"] for r in rows if now - r["at"] <= max_age_h * 3600}


def save_done(spark: SparkSession, path: str, done: set[str], now: float) -> None:
    """Write the finished cells in one committed overwrite."""
    spark.createDataFrame([(c, now) for c in sorted(done)], "cell string, at double").coalesce(1).write.mode("overwrite").json(path)


def merged(store: DataFrame, rows: DataFrame, schema: str) -> DataFrame:
    """ppn, record: rows laid over the records that the store has for them."""
    known = raw_store.records(store.join(rows.select("ppn"), "ppn", "left_semi"), schema).drop(*raw_store.STAMPS)
    laid = raw_store.overlay(known, rows)
    return laid.select("ppn", raw_store.body(laid).alias("record"))


def sync(store: DataFrame, feed: DataFrame, schema: str, now: str, streak: int = raw_store.STREAK) -> DataFrame:
    """Take up a newest-first feed until a run of unchanged records says that the rest is known."""
    flagged = raw_store.changed_against(feed, raw_store.records(store, schema))
    news = raw_store.streak_cut(flagged, F.col("changed"), streak).where("changed").drop("changed", "position")
    return raw_store.put(store, merged(store, news, schema), now, is_live=True)


def reparse(store: DataFrame, schema: str, now: str) -> DataFrame:
    """Parse the stored pages again and lay what they say over the records; nothing becomes live by it."""
    found = pages.parse_details(raw_store.pages(store))
    names = {f.split()[0] for f in schema.split(", ")}
    return raw_store.put(store, merged(store, found.select(*[c for c in found.columns if c in names]), schema), now)


def add_pages(store: DataFrame, fetched: DataFrame, schema: str, now: str) -> DataFrame:
    """Attach fetched pages (ppn, html) and parse them."""
    with_pages = raw_store.put_pages(store, fetched, now)
    mine = with_pages.join(fetched.select("ppn"), "ppn", "left_semi")
    rest = with_pages.join(fetched.select("ppn"), "ppn", "left_anti")
    return reparse(mine, schema, now).unionByName(rest)


def full_run(store: DataFrame, rows: DataFrame, cells: DataFrame, expected: DataFrame, schema: str, now: str, all_formats: bool, formats: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Upsert a whole enumeration; mark what is missing only if it provably saw everything. Gives also whether it did."""
    after = raw_store.put(store, merged(store, rows, schema), now, is_live=True)
    if not all_formats or not raw_store.completeness(cells, expected, formats).first()["removal_safe"]:
        return after, False
    return raw_store.reconcile(after, rows.select("ppn"), now)


_LOCK = threading.Lock()


def refresh(steps: Iterable[tuple[str, Callable[[], object]]]) -> list[str] | None:
    """Run steps in order, one refresh at a time: None if another one runs. A step that fails ends it; gives the steps done."""
    if not _LOCK.acquire(blocking=False):
        return None
    done: list[str] = []
    try:
        for name, step in steps:
            step()
            done.append(name)
    except Exception:
        return done
    finally:
        _LOCK.release()
    return done


def optional(build: Callable[[], DataFrame], fallback: DataFrame | None = None) -> DataFrame | None:
    """The result of a build that must never fail the whole, or the fallback."""
    try:
        return build()
    except Exception:
        return fallback


def replace_method(edges: DataFrame | None, new: DataFrame, methods: Iterable[str]) -> DataFrame:
    """Similarity edges with one method's rows replaced; rows of methods that no longer exist drop."""
    if edges is None or "method" not in edges.columns:
        return new
    fresh = new.select("method").distinct()
    kept = edges.where(F.col("method").isin(*methods)).join(F.broadcast(fresh), "method", "left_anti")  # one row a method
    return kept.select(*new.columns).unionByName(new)
