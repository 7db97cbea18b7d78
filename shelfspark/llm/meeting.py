"""Members of one key meet in groups of bounded size, however large the key is.

A key with few members is one group. A key with more is dealt into parts, and every two parts meet in
a group of their own, so that each pair of members shares a group, no task holds a whole crowd, and
the pairs themselves are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import workspace

#: Members and bytes of one part; a group holds two parts at most.
PART_ROWS, PART_BYTES = 1024, 16_000_000
#: Bytes that a Python worker is handed at once.
BATCH_BYTES = 8_000_000


def deal(members: DataFrame, key: str, member: str, weight: str | None = None) -> DataFrame:
    """Adds part, a and b to members: rows with equal (key, a, b) are a group.

    weight: a column with a member's bytes. A row of a key with k parts is in k groups; in group
    (a, b) the members of part a meet those of part b, and with a = b each other.
    """
    sizes = [F.count(F.lit(1)) / PART_ROWS, *([F.sum(weight) / PART_BYTES] if weight else [])]
    large = members.groupBy(key).agg(F.ceil(F.greatest(*sizes) if weight else sizes[0]).cast("int").alias("parts")).where("parts > 1")
    large = workspace.materialize(large, "large_keys")
    dealt = members.join(workspace.broadcast_if_small(large), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(member, key), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other", "parts")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first columns, cut so that no group is split: rows and where each group begins (one more: the end).

    rows: as many are gathered at least, where there are so many.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and sum(b.num_rows for b in held) >= rows:
            same = np.logical_and.reduce([batch.column(i).to_numpy(zero_copy_only=False) == held[-1].column(i)[-1].as_py() for i in range(keys)])
            begin = len(same) if same.all() else int(same.argmin())
            if begin < len(same):  # a group ends in this batch: all before it is whole
                if begin:
                    held.append(batch.slice(0, begin))
                whole = _joined(held)
                yield whole, _edges(whole, keys)
                held, batch = [], batch.slice(begin)
        held.append(batch)
    if held:
        whole = _joined(held)
        yield whole, _edges(whole, keys)


def _edges(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [batch.num_rows]])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
