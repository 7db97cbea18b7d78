"""Near-duplicate documents by DartMinHash.

A text is a weighted set: its five-word shingles, each weighing as often as it occurs. Darts are
thrown at the plane of (element and weight) x rank, as many in any unit region as a Poisson variable
with mean 1, number, places and coordinates all read off hashes of the region, so that sets which
share a region share its darts. A set is hit by the darts in the regions of its elements up to their
weights; the earliest dart by rank in each of K coordinates is its signature. Two signatures agree in
a coordinate with the probability of the sets' weighted Jaccard similarity. Ranks are only searched
as far as about K ln K darts reach, so long texts cost one hash and one dart a word.

Signatures are cut into bands; equal texts are one node from the start. Nodes of one bucket of a band
meet in groups of bounded size, which hold every node's regions once: each two of them are compared
by the exact weighted Jaccard similarity of the whole texts, and only the links that join something
are given out, so pairs are never rows. The first bands alone make most components; of the other
bands only buckets that still hold several components meet, each node outside the largest one with
all others. No pair of a bucket is left out but those already connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.operators import graph

from . import meeting, tokenizing, wordhash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Bands that meet in the first round.
FIRST_BANDS = 6
K = BANDS * ROWS
DARTS = K * (math.log(K) + 2)
#: Chances that a Poisson variable with mean 1 is at most 0, 1, 2, ..., as 64-bit fractions.
_POISSON = np.array([min(2**64 - 1, int(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) * 2**64)) for i in range(12)], np.uint64)
_RANK_BITS = 20
#: Bytes of a table of nodes or rows that is broadcast. Hashed by its keys it takes more than that of the driver, which
#: may hold several of them at once; larger ones are joined by a shuffle.
BROADCAST_BYTES = 4_000_000
#: Unit regions that are looked at together.
_AT_ONCE = 1 << 20


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions of weighted shingle sets: a hash for each shingle and each unit of its weight, sorted within a text, and where each text's begin."""
    h, at = wordhash.shingles(texts, WORDS)
    for a, b in zip(at[:-1], at[1:], strict=True):
        h[a:b].sort()
    if not len(h):
        return h, at
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    unit = (np.arange(len(h)) - start).astype(np.uint64)
    return np.where(unit > 0, wordhash.mix(h + unit * wordhash.GOLDEN), h), at


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """texts x K: the earliest dart of each coordinate. Texts without cells have all ones."""
    n = len(at) - 1
    out = np.full(n * K, ~np.uint64(0))
    reach = np.zeros(n)
    todo = np.flatnonzero(np.diff(at))
    reach[todo] = DARTS / np.diff(at)[todo]
    while len(todo):
        work = np.cumsum(np.diff(at)[todo] * np.ceil(reach[todo]))
        for some in np.split(todo, np.searchsorted(work, np.arange(_AT_ONCE, work[-1], _AT_ONCE))):
            if len(some):
                _throw(h, at, some, reach, out)
        table = out.reshape(n, K)
        missed = todo[(table[todo] == ~np.uint64(0)).any(axis=1)]
        reach[missed] *= 2  # some coordinate has no dart yet: throw as many again
        todo = missed
    return out.reshape(n, K)


def _throw(h: np.ndarray, at: np.ndarray, which: np.ndarray, reach: np.ndarray, out: np.ndarray) -> None:
    sizes = at[which + 1] - at[which]
    rounds = np.ceil(reach[which]).astype(np.int64)  # unit ranks to look at
    cell = np.arange(sizes.sum()) + np.repeat(at[which] - (np.cumsum(sizes) - sizes), sizes)
    owner, many = np.repeat(which, sizes), np.repeat(rounds, sizes)
    rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner = np.repeat(owner, many)
    region = wordhash.mix(np.repeat(h[cell], many) ^ wordhash.mix((rank + 1).astype(np.uint64) * wordhash.GOLDEN))
    darts = np.searchsorted(_POISSON, region, "right")
    nth = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = wordhash.mix(np.repeat(region, darts) + (nth + 1).astype(np.uint64) * wordhash.GOLDEN)
    owner = np.repeat(owner, darts)
    place = np.repeat(rank, darts).astype(np.uint64) << np.uint64(_RANK_BITS) | dart >> np.uint64(64 - _RANK_BITS)
    near = place < (reach[owner] * (1 << _RANK_BITS)).astype(np.uint64)
    dart, owner, place = dart[near], owner[near], place[near]
    coordinate = (dart & np.uint64(0xFFFFFFFF)) % np.uint64(K)
    key = place << np.uint64(32) | wordhash.mix(dart) >> np.uint64(32)  # rank first, then the dart's own name
    np.minimum.at(out, owner * K + coordinate.astype(np.int64), key)


def band_hashes(table: np.ndarray) -> np.ndarray:
    """texts x BANDS: a hash of each band's coordinates and number."""
    parts = table.reshape(len(table), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * wordhash.GOLDEN, parts.shape[:2]).copy()
    for r in range(ROWS):
        out = wordhash.mix(out ^ parts[:, :, r])
        out *= np.uint64(0x2545F4914F6CDD1D)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted cell arrays: cells in both by cells in either."""
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return min(len(a), len(b)) / max(len(a), len(b))  # an upper bound, already below the threshold
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, texts in tokenizing.slices(batch.column(0), batch.column(1)):
            h, at = cells(texts)
            sizes = np.diff(at)
            bands = band_hashes(signatures(h, at)).view(np.int64)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            digests = [hashlib.md5(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes * 8), found], ["doc_id", "digest", "bytes", "bands"])


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, its regions sorted."""
    for batch in batches:
        for nodes, texts in tokenizing.slices(batch.column(0), batch.column(1)):
            h, at = cells(texts)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([np.sort(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "cells"])


def joining_links(roots: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions of linked members of one group, as few as join all that any links join.

    roots: members of one component have one; sets: their sorted regions. Members meet those of the
    other part, or all if there is one part. Members of the largest component are only met by others.
    """
    n, sizes, links = len(sets), np.array([len(s) for s in sets]), []
    label, across = np.unique(roots, return_inverse=True)[1], parts.min() != parts.max()
    if n == 2:
        return [(0, 1)] if label[0] != label[1] and similarity(sets[0], sets[1]) >= SIMILARITY else []
    code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), sizes)
    shared = many[code] > 1  # a region of one member alone is in no pair
    code, owner = code[shared], owner[shared]
    held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    by_code = owner[np.argsort(code, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(many)))])
    largest = np.bincount(label).argmax()
    for x in np.flatnonzero(label != largest).tolist() if np.bincount(label).max() > 1 else range(1, n):
        mine = code[held[x] : held[x + 1]]
        width = start[mine + 1] - start[mine]
        at = np.arange(width.sum()) + np.repeat(start[mine] - (np.cumsum(width) - width), width)
        both = np.bincount(by_code[at], minlength=n)
        near = (both >= SIMILARITY * (sizes + sizes[x] - both)) & (label != label[x])
        if across:
            near &= parts != parts[x]
        for y in np.flatnonzero(near).tolist():
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows bucket, a, b, part, node, root, cells, sorted by group: links u, v."""
    for rows, edges in meeting.whole_groups(batches, 3):
        part, node, root = (rows.column(i).to_numpy() for i in (3, 4, 5))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(6)[a:b]]
                out += [(node[a + i], node[a + j]) for i, j in joining_links(root[a:b], part[a:b], sets)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["u", "v"])


def _links(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Links of the groups of members (bucket, a, b, part, node, root)."""
    held = members.join(workspace.shuffled(regions), "node").select("bucket", "a", "b", "part", "node", "root", "cells")
    met = held.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(_meet, "u long, v long")
    return workspace.materialize(met, "links", meeting.BATCH_BYTES)


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it is small enough for the driver to hold several such."""
    return workspace.broadcast_if_small(df, BROADCAST_BYTES)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, class_id, kept and twins for every row of docs.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles (lower case,
    punctuation left out; a text of 1 to 4 words is one shingle) is SIMILARITY or more; classes are
    connected. Equal texts are in one class, empty ones too. A class is named class_id after its row
    with the least doc_id, null ids last, ties to the least digest; kept marks that one row, so a class
    has one even where ids are null or repeated. twins: another row has the same doc_id and text. A
    null text is a class of its own, with a null digest, and kept. An empty table gives no rows.
    """
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = read.where(F.col("text").isNotNull()).mapInArrow(_sign, "doc_id long, digest binary, bytes long, bands array<long>")
    signed = workspace.materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed", meeting.BATCH_BYTES)
    # Equal texts become one node, named by a number that is fixed once the table is written.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row")
    nodes = signed.groupBy("digest").agg(F.min(place).alias("first"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    nodes = workspace.materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    in_bands = nodes.where("bytes > 0").select("node", "bytes", F.posexplode("bands").alias("band", "bucket"))
    crowds = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    meet = workspace.materialize(in_bands.join(workspace.shuffled(crowds), "bucket"), "in_buckets")
    named = workspace.shuffled(nodes.select("node", "digest", F.col("first.doc_id").alias("first")))
    wanted = workspace.materialize(meet.select("node").distinct().join(named, "node"), "wanted")
    same = read["doc_id"].eqNullSafe(F.col("first")) & (F.unhex(F.md5(read["text"].cast("binary"))) == F.col("digest"))
    texts = read.join(_small(wanted), same).select("node", "text")
    regions = workspace.materialize(texts.mapInArrow(_cells_of, "node long, cells binary").dropDuplicates(["node"]), "regions", meeting.BATCH_BYTES)

    dealt = workspace.materialize(meeting.deal(meet, "bucket", "node", "bytes"), "dealt")
    early = (F.col("band") < FIRST_BANDS) & (F.col("a") == F.col("b"))
    links = _links(dealt.where(early).withColumn("root", F.col("node")), regions)
    roots = graph.components(links)
    rooted = dealt.where(~early).join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = workspace.materialize(rooted, "rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
    links = links.unionByName(_links(rooted.join(workspace.shuffled(several), "bucket"), regions))
    roots = graph.components(links)

    grouped = nodes.select("node", "digest", "first").join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    classed = workspace.materialize(grouped.join(workspace.shuffled(least), "root").select("digest", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("kept_row")), "classes")
    found = signed.select("doc_id", "digest", "row").join(_small(classed), "digest")
    repeated = signed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("digest").alias("text_digest"), F.lit(True).alias("twins"))
    repeated = _small(workspace.materialize(repeated, "twins"))
    found = found.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text_digest")), "left")
    out = found.select("doc_id", "digest", "class_id", (F.col("row") == F.col("kept_row")).alias("kept"), F.coalesce("twins", F.lit(False)).alias("twins"))
    alone = read.where(F.col("text").isNull())
    out = out.unionByName(alone.select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(False).alias("twins")))
    return workspace.materialize(out, "classed")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, the one that classes() marks; columns as they are. Rows with null texts stay.

    Of rows with the same doc_id and text any one stays. Columns of docs may have any names.
    """
    named = classes(docs).where(F.col("digest").isNotNull())
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.unhex(F.md5(F.col("doc.text").cast("binary"))) == F.col("digest"))
    # Rows that go are far fewer than those that stay: while they are small no text moves.
    gone = workspace.materialize(named.where("twins OR NOT kept").select("doc_id", "digest").distinct(), "gone")
    one = packed.where(F.col("doc.text").isNotNull()).join(_small(gone), same, "left_anti")
    some = named.where("twins AND kept").select("doc_id", "digest")
    if not some.isEmpty():
        one = one.unionByName(packed.join(_small(some), same).dropDuplicates(["digest"]).select("doc"))
    return one.unionByName(packed.where(F.col("doc.text").isNull())).select("doc.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; kept marks the document that stands for its class."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
