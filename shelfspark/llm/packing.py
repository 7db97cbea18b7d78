"""Best-fit packing of token sequences by minimum bin slack.

Only lengths matter for packing, so the packer works on a histogram: how many pieces there are of
each length up to the capacity, a table of fixed size. A bin begins with the longest piece left; a
bitset subset-sum over the lengths left, with their counts, finds the fullest combination that fits
beside it; the combination is taken as often as the counts allow, and removed. Each round uses up a
length or nearly so, hence the number of different combinations is bounded by the capacity, not by
the data. Pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfspark import workspace

from . import tokenizing

CAPACITY = 1024
#: Chunks that a worker remembers; a task here holds little else.
MEMO_ENTRIES = 1_500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats, of the fullest combination that fits into room; longer lengths first.

    Bit s of a bitset tells whether the lengths seen so far can sum to s. A length with count n is
    added in shares of 1, 2, 4, ... copies. The walk back over the bitsets takes the combination.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    full, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int]] = []  # (share's size, sums reachable before it)
    units: list[tuple[int, int]] = []
    for x in lengths:
        left, copies = min(counts[x], room // x), 1
        while left:
            take = min(copies, left)
            steps.append((take * x, reach))
            units.append((x, take))
            reach |= reach << take * x & full
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, []
    for (size, before), (x, take) in zip(reversed(steps), reversed(units), strict=True):
        if not before >> s & 1:
            s -= size
            out += [x] * take
    return sorted(out, reverse=True)


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many bins have each. counts: pieces of each length, 1 to capacity."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        combination = [first, *fullest(rest, capacity - first)]
        uses = {x: combination.count(x) for x in combination}
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((combination, times))
    return out


class Places:
    """Where the pieces of a packing go: by length and rank among the pieces of that length."""

    def __init__(self, packing: list[tuple[list[int], int]]):
        seen: dict[int, int] = {}
        spans = []  # (length, first rank, first bin, offset in the bin)
        first_bin = 0
        for combination, times in packing:
            offset = 0
            for x in combination:
                spans.append((x, seen.get(x, 0), first_bin, offset))
                seen[x] = seen.get(x, 0) + times
                offset += x
            first_bin += times
        spans.sort()
        self.bins = first_bin
        table = np.array(spans, np.int64).reshape(-1, 4)
        self._keys, self._ranks, self._bins, self._offsets = (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets of pieces."""
        at = np.searchsorted(self._keys, (length << 44) + rank, "right") - 1
        return self._bins[at] + rank - self._ranks[at], self._offsets[at]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: a shorter first piece, then full ones."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def cut_documents(docs: DataFrame, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece, with the task that made it and its rank in that task among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizing.hand_back()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for ks, texts in tokenizing.slices(batch.column(0), batch.column(1)):
                ids, at = encode(texts)
                rows = []
                for k, a, b in zip(ks, at[:-1], at[1:], strict=True):
                    own = memoryview(np.concatenate([ids[a:b], end]).astype("<u4")).cast("B")
                    for i, (start, n) in enumerate(cut(len(own) // 4, capacity)):
                        rows.append((k, i, start, n, zlib.crc32(own[4 * start : 4 * (start + n)]), part, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece with end_id alone. Rows with equal or null keys are packed like
    any others. An empty table gives no rows. Other columns of docs are not looked at.

    A piece's rank among all pieces of its length is its rank in its task plus the pieces of that
    length in the tasks before: one number for each task and length, so that a length that a third
    of all pieces have is no group of any task.
    """
    pieces = workspace.materialize(cut_documents(docs, encode, end_id, capacity, key, text), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(pack(counts, capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranks = per_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizing.hand_back()
        for batch in batches:
            bins, offsets = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes whole texts with a byte-level file of the tokenizers library."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return tokenizing.memo(("byte", path), lambda: tokenizing.byte_level_encoder(path), tokenizing.alone, MEMO_ENTRIES).ids([tokenizing.spaced_chunks(t) for t in texts])

    return encode


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    import public_tokenizers as tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoder(tokenizers.path("byte_bpe_50k.json")), end_id=2)
