"""Exact top-k inner products from a bit-sliced index.

Each attribute (vector component, quantised to an integer and shifted to be non-negative) is held as
bit slices: one bitmap a bit, a bit a row. For a query, the slices of an attribute are added once for
each 1 bit of the query's weight, shifted by that bit, with a negative weight as an addition of the
complement. Bitmaps of equal significance are added three at a time (sum and carry), which leaves the
bit slices of every row's score. The best k rows are selected from the most significant slice down:
while the rows that have the bit are fewer than are still wanted they are all taken, else the others
drop out. Rows that remain equal in all slices are a tie and are resolved by the smaller id.

Rows are dealt into blocks of a fixed size by a hash of the id, and a block's slices are built once and
stored. The query set meets every block: the queries, in parts of their own, stream past a block that
stays where it is. What is shuffled is the index, once a lane, and the queries, once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark import workspace

BLOCK_ROWS, QUERY_ROWS = 8192, 512
K, STEP, SCALE = 5, 50, 256


class BitSliced:
    """Index of one block. ids: int64; values: integers, rows x attributes."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order].astype(np.int64)
        self.rows = len(ids)
        self.low = values.min(axis=0) if self.rows else np.zeros(values.shape[1], np.int64)
        shifted = values.view(np.uint64) - self.low.view(np.uint64)
        self.words = -(-self.rows // 64)
        self.bits = int(shifted.max()).bit_length() if shifted.size else 0
        planes = [np.packbits((shifted >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little") for b in range(self.bits)]
        plain = np.zeros((self.bits, values.shape[1], self.words * 8), np.uint8)
        for b, p in enumerate(planes):
            plain[b, :, : p.shape[0]] = p.T
        plain = plain.view(np.uint64)
        self._arrange(plain)

    def _arrange(self, plain: np.ndarray) -> None:
        self.slices = np.stack([plain, ~plain], axis=2).reshape(self.bits, 2 * plain.shape[1], self.words)  # each slice and its complement
        self.valid = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        self.valid[: len(packed)] = packed
        self.valid = self.valid.view(np.uint64)

    def stored(self) -> tuple[bytes, bytes, bytes]:
        """ids, least values and slices as bytes."""
        return self.ids.tobytes(), self.low.tobytes(), np.ascontiguousarray(self.slices[:, ::2]).tobytes()

    @classmethod
    def read(cls, ids: bytes, low: bytes, slices: bytes) -> BitSliced:
        """An index from what stored() gave."""
        out = cls.__new__(cls)
        out.ids, out.low = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
        out.rows, out.words = len(out.ids), -(-len(out.ids) // 64)
        plain = np.frombuffer(slices, np.uint64)
        out.bits = len(plain) // max(1, len(out.low) * out.words)
        out._arrange(plain.reshape(out.bits, len(out.low), out.words))
        return out

    def score_slices(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices of every row's score, least significant first, and the constant to add to it."""
        constant, left, q = sum(w * v for w, v in zip(weights.tolist(), self.low.tolist(), strict=True)), weights.astype(np.int64), 0
        piles: list[list[np.ndarray]] = []
        while left.any():
            digit = (left & 1) * (2 - (left & 3))  # 1, 0 or -1: no two neighbours of a weight's digits are both set
            left = left - digit >> 1
            has = np.flatnonzero(digit)
            if len(has):
                while len(piles) < q + self.bits:
                    piles.append([])
                minus = digit[has] < 0
                constant -= int(minus.sum()) * ((1 << self.bits) - 1) << q  # less a slice is its complement less all ones
                chosen = 2 * has + minus
                for b in range(self.bits):
                    piles[q + b].append(self.slices[b, chosen])
            q += 1
        out, at = [], 0
        while at < len(piles):
            pile = np.concatenate(piles[at]) if piles[at] else np.zeros((0, self.words), np.uint64)
            while len(pile) > 1:
                if len(piles) == at + 1:
                    piles.append([])
                thirds = len(pile) // 3
                if thirds:
                    a, b, c = pile[:thirds], pile[thirds : 2 * thirds], pile[2 * thirds : 3 * thirds]
                    ab = a ^ b
                    carry = ab & c
                    carry |= a & b
                    piles[at + 1].append(carry)
                    ab ^= c
                    pile = np.concatenate([ab, pile[3 * thirds :]])
                else:
                    piles[at + 1].append(pile[:1] & pile[1:2])
                    pile = pile[:1] ^ pile[1:2]
            out.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            at += 1
        return np.array(out).reshape(len(out), self.words), constant

    def top(self, weights: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int]]:
        """Score and id of the k best rows whose id is not but, best first, ties to the smaller id."""
        slices, constant = self.score_slices(weights)
        candidates, taken, wanted = self.valid.copy(), np.zeros(self.words, np.uint64), k
        if but is not None:
            for r in range(*np.searchsorted(self.ids, [but, but + 1]).tolist()):
                candidates[r >> 6] &= ~np.uint64(1 << (r & 63))
        for s in slices[::-1]:
            high = candidates & s
            n = int(np.bitwise_count(high).sum())
            if n > wanted:
                candidates = high
            else:
                taken |= high
                candidates &= ~s
                wanted -= n
            if not wanted:
                break
        rows = self._rows(taken)
        if wanted:
            rows = np.concatenate([rows, self._rows(candidates)[:wanted]])  # equal in all slices; rows are in order of id
        scores = np.full(len(rows), constant % (1 << 64), np.uint64).view(np.int64)
        for b, s in enumerate(slices[:64]):
            scores += ((s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)) << b
        return sorted(zip(scores.tolist(), self.ids[rows].tolist(), strict=True), key=lambda x: (-x[0], x[1]))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return at[row] * 64 + bit


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key as id and q: floor(SCALE * x) of each component. Vectors that are null or empty, or hold null or non-finite components, are left out, and so are null keys. Beyond the range of a long q is its end."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return df.where((F.size(vector) > 0) & F.col(key).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("q"))


def top_k(index: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of index for every row of queries, the query's own id left out.

    Both have id and q (an integer array). Only vectors as long as the query can meet it. An id that
    index repeats counts once a row. Empty inputs give no rows; fewer rows than k give them all. Rows
    are chosen by exact scores of any size; the score given out is exact as far as a long holds it.
    """
    spark = index.sparkSession
    index = workspace.materialize(index.withColumn("dims", F.size("q")), "vectors")
    n = index.count()
    blocks = max(1, -(-n // block_rows))
    # A row's block depends on its id and its place among equal ids, so that no id fills a block.
    place = F.pmod(F.xxhash64("id", "q", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, low, slices = BitSliced(pdf["id"].to_numpy(np.int64), np.array(pdf["q"].tolist(), np.int64)).stored()
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "dims": pdf["dims"].iloc[:1], "ids": [ids], "low": [low], "slices": [slices]})

    packed = index.withColumn("block", place).groupBy("block", "dims").applyInPandas(build, "block int, dims int, ids binary, low binary, slices binary")
    packed = workspace.materialize(packed, "bit_sliced")

    asked = workspace.materialize(queries.withColumn("dims", F.size("q")), "queries")
    parts = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    grouped = asked.groupBy("part", "dims").applyInPandas(
        lambda pdf: pd.DataFrame({"part": pdf["part"].iloc[:1], "dims": pdf["dims"].iloc[:1], "qids": [pdf["id"].to_numpy(np.int64).tobytes()], "w": [np.array(pdf["q"].tolist(), np.int64).tobytes()]}),
        "part int, dims int, qids binary, w binary",
    )
    grouped = workspace.materialize(grouped, "query_parts")
    # Few blocks are copied to lanes, each for a share of the queries, to occupy all cores.
    lanes = min(parts, max(1, spark.sparkContext.defaultParallelism // blocks))
    each = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    rows = packed.select("block", "dims", each(lanes).alias("lane"), F.lit(-1).alias("part"), "ids", "low", "slices", *none("qids", "w"))
    sent = grouped.select(each(blocks).alias("block"), "dims", (F.col("part") % lanes).cast("int").alias("lane"), "part", *none("ids", "low", "slices"), "qids", "w")
    pairs = rows.unionByName(sent).repartition(max(blocks * lanes, 12), "block", "lane").sortWithinPartitions("block", "lane", "dims", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, dims, lane, part = (batch.column(c)[i].as_py() for c in range(4))
                if part < 0:
                    held, index = (number, dims, lane), BitSliced.read(*(batch.column(c)[i].as_py() for c in (4, 5, 6)))
                    continue
                if held != (number, dims, lane):  # no row of the block has so many components
                    continue
                out = []
                ids, w = np.frombuffer(batch.column(7)[i].as_py(), np.int64).tolist(), np.frombuffer(batch.column(8)[i].as_py(), np.int64).reshape(-1, dims)
                for qid, weights in zip(ids, w, strict=True):
                    out += [(qid, i, s) for s, i in index.top(weights, k, but=qid)]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 50th vector's 5 best inner products among all the others."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % STEP == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
