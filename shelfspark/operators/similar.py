"""Content-based neighbours: token bags, TF-IDF, truncated SVD, exact cosine neighbours in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import workspace

# Function words that carry no topic, and field weights.
STOP_WORDS = (
    "de het een en van te dat die in op aan met voor is als maar om ook door naar of zijn was wordt worden werd hij zij ze we wij ik jij je u men er hier daar dan "
    "nog wel niet geen zo toen nu al deze dit zulke over onder tussen bij uit tot na zonder tegen per want omdat terwijl toch echter zoals meer meest zeer heel erg "
    "hun haar ons onze jullie mijn wie wat waar waarom hoe welke welk heeft hebben had hadden kan kunnen kon konden zal zullen zou zouden moet moeten "
    "mag mogen wil willen weer eens even nooit altijd vaak soms iemand iets niets alles elk elke ieder iedere beide zowel dus alleen samen zelf zich"
).split()
WEIGHTS = {"genre": 3, "keyword": 2, "title": 2, "summary": 1}
MIN_LENGTH, NEIGHBOURS, MIN_SCORE, DIMENSIONS, BLOCK = 3, 24, 0.10, 300, 1024
METHODS = ("lsa",)
#: Tokens whose document frequencies every task holds, and tokens that are counted together.
COMMON, TOGETHER = 1 << 17, 1 << 22
#: Bytes of vectors that a task holds against its own, and bytes that a Python worker is handed at once.
CHUNK_BYTES, BATCH_BYTES = 32_000_000, 8_000_000


def words(c: Column | str) -> Column:
    """Lower-case words of Latin letters and digits, without function words and short ones."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-zà-ÿ0-9]+)"))
    return F.filter(found, lambda w: (F.length(w) >= MIN_LENGTH) & ~w.isin(*STOP_WORDS))


def _again(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def _text_tokens() -> Column:
    """Tokens of a work's texts, repeated by weight; keywords in a name space of their own."""
    keywords = F.transform(words("keywords"), lambda w: F.concat(F.lit("k·"), w))
    return F.concat(_again(keywords, WEIGHTS["keyword"]), _again(words("title"), WEIGHTS["title"]), words("summary"))


def _genre_token() -> Column:
    """A genre's token, in the name space of genres."""
    return F.concat(F.lit("g·"), F.regexp_replace(F.lower(F.trim("genre")), r"\s+", "_"))


def bags(works: DataFrame, work_genres: DataFrame) -> DataFrame:
    """work_id, token, tf: categorical fields in name spaces of their own, repeated by weight."""
    tagged = work_genres.groupBy("work_id").agg(F.collect_list(_genre_token()).alias("g"))
    joined = works.select("work_id", "title", "summary", "keywords").join(tagged, "work_id", "left")
    genres = _again(F.coalesce("g", F.array().cast("array<string>")), WEIGHTS["genre"])
    return joined.select("work_id", F.explode(F.concat(genres, _text_tokens())).alias("token")).groupBy("work_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(tokens: DataFrame, min_df: int = 2) -> DataFrame:
    """work_id, token, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows of length 1."""
    n = tokens.agg(F.countDistinct("work_id").alias("n"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = tokens.join(df, "token").crossJoin(F.broadcast(n)).select("work_id", "token", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("work_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "work_id").select("work_id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def counted(works: DataFrame) -> DataFrame:
    """work_id, token, tf of a work's texts as int64 and int32: its different tokens by hash, in order, and how often each occurs.

    No text moves, but where works occur more than once.
    """
    known = works.select("work_id", "title", "summary", "keywords").where("work_id IS NOT NULL")
    if known.groupBy("work_id").count().where("count > 1").isEmpty():
        moved = known
    else:
        moved = known.repartition("work_id").sortWithinPartitions("work_id")
    hashed = moved.select("work_id", F.transform(_text_tokens(), lambda t: F.xxhash64(t)).alias("tokens"))
    kind = dict(works.dtypes)["work_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, begun = None, False
        for batch in batches:
            out = []
            at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for i, me in enumerate(batch.column(0).to_pylist()):
                if begun and me != key:
                    out.append((key, np.concatenate(held)))
                    held = []
                key, begun = me, True
                held.append(flat[at[i] : at[i + 1]])
            yield packed(out)
        if begun:
            yield packed([(key, np.concatenate(held))])

    def packed(rows: list) -> pa.RecordBatch:
        found = [(me, *np.unique(tokens, return_counts=True)) for me, tokens in rows]
        columns = [[r[0] for r in found], [r[1].tobytes() for r in found], [r[2].astype(np.int32).tobytes() for r in found]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["work_id", "token", "tf"])

    arrow = _arrow(kind)
    return workspace.materialize(hashed.mapInArrow(count, f"work_id {kind}, token binary, tf binary"), "counted_tokens", BATCH_BYTES)


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of keys."""
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def lsa_rows(tokens: DataFrame, work_genres: DataFrame, min_df: int = 2, features: int = 4096, common: int = COMMON) -> DataFrame:
    """work_id, f, x of counted tokens and genres: a work's TF-IDF row of length 1 in hashed signed features (int16 and float32).

    Weights are those of tf_idf. Document frequencies of the commonest tokens go to every task, as many as
    it may hold. Occurrences of the others, which are few, and of genres meet theirs by a shuffled join,
    and go to their works, whose rows move once. tokens is discarded.
    """
    spark, kind = tokens.sparkSession, dict(tokens.dtypes)["work_id"]
    genres = work_genres.select("work_id", F.xxhash64(_genre_token()).alias("token"), _genre_token().alias("g")).where("g IS NOT NULL").groupBy("work_id", "token").agg((WEIGHTS["genre"] * F.count(F.lit(1))).cast("int").alias("tf"))
    genres = workspace.materialize(genres.join(tokens.select("work_id", (F.octet_length("token") == 0).alias("bare")), "work_id"), "genre_tokens")

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], ["token", "n"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [np.frombuffer(t, np.int64) for t in batch.column(0).to_pylist()]
            if sum(map(len, held)) >= TOGETHER:
                yield counts(held)
                held = []
        if held:
            yield counts(held)

    parts = tokens.select("token").mapInArrow(frequencies, "token long, n long").unionByName(genres.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    df = workspace.materialize(parts.groupBy("token").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df), "document_frequencies", BATCH_BYTES)
    n = tokens.where(F.octet_length("token") > 0).count() + genres.where("bare").select("work_id").distinct().count()
    least = sofar = 0
    for r in df.groupBy("df").count().orderBy(F.desc("df")).collect():
        sofar += r["count"]
        if sofar > common:
            least = r["df"]
            break
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    known = df.where(F.col("df") > least).select("token", idf.alias("idf")).toPandas().sort_values("token")
    shared = spark.sparkContext.broadcast((known["token"].to_numpy(np.int64), known["idf"].to_numpy(np.float64)))

    def split(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each work its tokens, their frequencies in it, which are common, and where."""
        every = shared.value[0]
        for token, tf in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            t = np.frombuffer(token, np.int64)
            at = np.minimum(np.searchsorted(every, t), max(0, len(every) - 1))
            yield t, np.frombuffer(tf, np.int32), every[at] == t if len(every) else np.zeros(len(t), bool), at

    def row(t: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.mod(t, features), w * (1.0 - 2.0 * (t >> 32 & 1)), features).astype(float)

    def sparse(ids: pa.Array, rows: list[np.ndarray], *more: pa.Array) -> pa.RecordBatch:
        at = [np.flatnonzero(x) for x in rows]
        f, x = [i.astype(np.int16).tobytes() for i in at], [x[i].astype(np.float32).tobytes() for x, i in zip(rows, at, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(f, pa.binary()), pa.array(x, pa.binary()), *more], ["work_id", "f", "x", *["squares"][: len(more)]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the common tokens, and the sums of their squared weights."""
        for batch in batches:
            found = [(t[hit], (1 + np.log(many[hit])) * shared.value[1][at[hit]]) for t, many, hit, at in split(batch)]
            yield sparse(batch.column(0), [row(t, w) for t, w in found], pa.array([float(w @ w) for _, w in found], pa.float64()))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of tokens that are not common."""
        for batch in batches:
            found = [(t[~hit], many[~hit]) for t, many, hit, _ in split(batch)]
            if found:
                mine = pa.array(np.repeat(np.arange(len(found)), [len(t) for t, _ in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], ["work_id", "token", "tf"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of weigh and the other tokens of each: whole rows of length 1."""
        for batch in batches:
            out = []
            for f, x, squares, more in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                rare = sorted((m["token"], m["w"]) for m in more or [])
                t, w = np.array([r[0] for r in rare], np.int64), np.array([r[1] for r in rare], np.float64)
                whole = row(t, w)
                whole[np.frombuffer(f, np.int16)] += np.frombuffer(x, np.float32)
                out.append(whole / (np.sqrt(squares + w @ w) or 1.0))
            kept = [i for i, x in enumerate(out) if x.any()]
            yield sparse(batch.column(0).take(pa.array(kept, pa.int64())), [out[i] for i in kept])

    rare = tokens.mapInArrow(others, f"work_id {kind}, token long, tf int").unionByName(genres.select("work_id", "token", "tf")).join(df.withColumn("idf", idf), "token")
    rare = rare.groupBy("work_id").agg(F.collect_list(F.struct("token", ((1 + F.log("tf")) * F.col("idf")).alias("w"))).alias("more"))
    rare = workspace.materialize(rare, "rare_tokens", BATCH_BYTES)
    weighed = workspace.materialize(tokens.mapInArrow(weigh, f"work_id {kind}, f binary, x binary, squares double"), "common_tokens", BATCH_BYTES)
    workspace.discard(tokens, genres, df)
    out = workspace.materialize(weighed.join(rare, "work_id", "left").mapInArrow(add, f"work_id {kind}, f binary, x binary"), "lsa_rows", BATCH_BYTES)
    workspace.discard(weighed, rare)
    return out


def lsa_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, features: int = 4096, rounds: int = 4) -> DataFrame:
    """work_id, vector: rows of the TF-IDF matrix in its leading directions, of length 1.

    Rows have a fixed number of features, so the Gram matrix that the directions come from has a fixed
    size at any vocabulary; it is summed over the partitions.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["work_id"]
    read = lambda batch, i: zip((np.frombuffer(f, np.int16) for f in batch.column(i).to_pylist()), (np.frombuffer(x, np.float32).astype(float) for x in batch.column(i + 1).to_pylist()), strict=True)

    def times(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            for at, x in read(batch, 0):
                total[at] += np.outer(x, x @ basis[at])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    n = rows.count()
    k = max(1, min(dimensions, features - 1, n - 1))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((features, k)))[0]
    for _ in range(rounds):  # subspace iteration: one pass over the rows each
        shared = spark.sparkContext.broadcast(basis)
        parts = rows.select("f", "x").coalesce(64).mapInArrow(lambda b, s=shared: times(b, s.value), "m binary")
        basis = np.linalg.qr(sum((np.frombuffer(bytes(r[0])).reshape(features, k) for r in parts.toLocalIterator()), np.zeros((features, k))))[0]
    shared = spark.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            out = [x @ b[f] for f, x in read(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v / (np.linalg.norm(v) or 1.0) for v in out], pa.list_(pa.float64()))], ["work_id", "vector"])

    return rows.mapInArrow(project, f"work_id {kind}, vector array<double>")


def cosine_neighbours(
    vectors: DataFrame, k: int = NEIGHBOURS, min_score: float = MIN_SCORE, key: str = "work_id", vector: str = "vector", block: int = BLOCK, queries: Column | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """key, rank (from 0), other, score: each row's k most similar others with min_score or more, ties to the least key.

    queries: a condition on the key; without it all rows ask. The rows that ask lie in blocks with their best
    so far, and in each round all of them meet one chunk of the table, which every task reads from the shared
    folder. No pair and no vector is shuffled for a meeting, so disk grows with the rows alone.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    arrow, names = _arrow(kind), ["ids", "v", "held", "others", "scores"]
    clean = workspace.materialize(vectors.where(F.size(vector) > 0).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")), "vectors")
    n, wide = clean.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    chunks = max(1, -(-n * 8 * (wide or 1) // chunk_bytes))
    lists = lambda rows, of: pa.array(rows, pa.list_(of))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows chunk, id, v: blocks of rows of one chunk, their vectors of length 1."""
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk).tolist():
                own = batch.filter(pa.array(chunk == c))
                v = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                for at in range(0, own.num_rows, block):
                    ids = own.column(1)[at : at + block].to_pylist()
                    yield pa.RecordBatch.from_arrays([lists([ids], arrow), pa.array([v[at : at + block].tobytes()], pa.binary()), pa.array([c], pa.int32())], ["c_ids", "c_v", "chunk"])

    numbered = clean.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    blocks = numbered.repartition(chunks, "chunk").select("chunk", "id", "v").mapInArrow(pack, f"c_ids array<{kind}>, c_v binary, chunk int")
    blocks = workspace.materialize(blocks, "vector_blocks", BATCH_BYTES, by="chunk")
    asking = clean if queries is None else clean.withColumnRenamed("id", key).where(queries).withColumnRenamed(key, "id")
    many = asking.count()
    parts = max(1, min(-(-many // 64), max(spark.sparkContext.defaultParallelism, -(-many // (8 * block)))))
    state = asking.select(F.lit(0).alias("chunk"), "id", "v").repartition(parts, "id").mapInArrow(pack, f"c_ids array<{kind}>, c_v binary, chunk int")
    none = (F.array_repeat(F.lit(0), F.size("c_ids")).alias("held"), F.array().cast(f"array<{kind}>").alias("others"), F.array().cast("array<double>").alias("scores"))
    state = workspace.materialize(state.select(F.col("c_ids").alias("ids"), F.col("c_v").alias("v"), *none), "asking", BATCH_BYTES)
    workspace.discard(clean)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of state and blocks, all those of a row of state together: state after these blocks."""
        now, best, floor, a = None, [], np.zeros(0), np.zeros(0)
        for batch in batches:
            for r in range(batch.num_rows):
                mine = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if mine != now:
                    if now is not None:
                        yield written(now, best)
                    now, a = mine, np.frombuffer(mine[1]).reshape(len(mine[0]), -1)
                    at = np.concatenate([[0], np.cumsum(batch.column(2)[r].as_py())])
                    found = list(zip([-x for x in batch.column(4)[r].as_py()], batch.column(3)[r].as_py(), strict=True))
                    best = [found[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                    floor = np.array([-x[-1][0] if len(x) == k else min_score for x in best])
                ids, b = np.array(batch.column(5)[r].as_py(), object), np.frombuffer(batch.column(6)[r].as_py()).reshape(len(batch.column(5)[r]), -1)
                s = a @ b.T >= floor[:, None] - 1e-9
                for i in np.flatnonzero(s.any(axis=1)).tolist():
                    j = np.flatnonzero(s[i])
                    j = j[ids[j] != now[0][i]]
                    exact = (a[i] * b[j]).sum(axis=1)  # the same for equal vectors wherever they stand
                    enough = exact >= floor[i]
                    if enough.sum() > k:
                        enough &= exact >= np.partition(exact, -k)[-k]
                    if enough.any():
                        best[i] = sorted([*best[i], *zip((-exact[enough]).tolist(), ids[j[enough]].tolist(), strict=True)])[:k]
                        floor[i] = -best[i][-1][0] if len(best[i]) == k else min_score
        if now is not None:
            yield written(now, best)

    def written(now: tuple, best: list) -> pa.RecordBatch:
        flat = [x for row in best for x in row]
        columns = [lists([now[0]], arrow), pa.array([now[1]], pa.binary()), lists([[len(x) for x in best]], pa.int32()), lists([[x[1] for x in flat]], arrow), lists([[-x[0] for x in flat]], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, others, scores in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                of = np.repeat(np.arange(len(ids)), held)
                rank = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in of], arrow), pa.array(rank, pa.int32()), pa.array(others, arrow), pa.array(scores, pa.float64())], [key, "rank", "other", "score"])

    for c in range(chunks):
        chunk = blocks.where(F.col("chunk") == c).drop("chunk").coalesce(1).hint("shuffle_replicate_nl")
        met = state.crossJoin(chunk).mapInArrow(meet, f"ids array<{kind}>, v binary, held array<int>, others array<{kind}>, scores array<double>")
        before, state = state, workspace.materialize(met, "asking", BATCH_BYTES)
        workspace.discard(before)
    workspace.discard(blocks)
    found = state.select("ids", "held", "others", "scores").mapInArrow(spread, f"`{key}` {kind}, rank int, other {kind}, score double")
    return found.withColumn("score", F.round("score", 4))


def build_similar(works: DataFrame, work_genres: DataFrame, method: str = "lsa", k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, queries: Column | None = None) -> DataFrame:
    """Similarity edges of a method: work_id, rank, other, score, method; of all works, or of those that queries says."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = lsa_rows(counted(works), work_genres)
    return cosine_neighbours(lsa_vectors(rows, dimensions), k, queries=queries).withColumn("method", F.lit(method))


def neighbours_of(edges: DataFrame | None, works: DataFrame, work_id: str, method: str = "lsa", limit: int = 20) -> DataFrame:
    """A work's neighbours in order; none where no edges have been built."""
    shown = works.select("work_id", "title", "author")
    if edges is None:
        return shown.limit(0).withColumn("score", F.lit(0.0))
    mine = edges.where((F.col("work_id") == work_id) & (F.col("method") == method)).select(F.col("other").alias("work_id"), "rank", "score")
    return mine.join(shown, "work_id").orderBy("rank").limit(max(1, min(limit, 30))).select("work_id", "title", "author", "score")
