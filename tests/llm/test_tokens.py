import base64
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from shelfspark import workspace  # noqa: E402
from shelfspark.llm import bpe, packing, records, tokenizing  # noqa: E402

PIECES = ["a", "b", "th", "'s", "'t", "'LL", " ", " ", "  ", "\n", " \n", "\n\n", "\t", "é", "ß", "中文", "\x1c", "\x85", chr(0x2003), chr(0x1680), "\x0b", "1", "23", "***", "_-", "🙂", chr(0x301), "\xa0", "İ", "Σ", "σς", "\0", "<|endoftext|>", " <|startoftext|> ", "word,", "İ***"]


def odd_texts(n=3000):
    rnd = random.Random(5)
    return ["", "a" * 3000, *("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n))]


@pytest.mark.parametrize("name, make, cut, ending", [("byte_bpe_50k.json", tokenizing.byte_level_encoder, tokenizing.spaced_chunks, tokenizing.alone), ("word_bpe_49k.json", tokenizing.word_level_encoder, tokenizing.plain_chunks, str)])
def test_chunks_give_the_ids_of_the_whole_text(name, make, cut, ending):
    whole = tokenizers.Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    memo = tokenizing.ChunkMemo(make(P.path(name)), ending, entries=500)  # resets many times
    texts = odd_texts()
    for i in range(0, len(texts), 100):
        ids, at = memo.ids([cut(t) for t in texts[i : i + 100]])
        for j, t in enumerate(texts[i : i + 100]):
            assert ids[at[j] : at[j + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_bpe_equals_tiktoken_and_decodes_back():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks, P.PATTERN)
    for t in odd_texts(1000):
        ids, at = bpe.encode_texts([t], path, P.PATTERN)
        assert ids.tolist() == enc.encode_ordinary(t) and own.decode(ids) == t.encode()
    rnd = random.Random(2)
    for _ in range(3000):
        w = bytes(rnd.choice(b"abcdefgh ethionr\xc3\xa9") for _ in range(rnd.randint(1, 16)))
        assert own.encode_word(w) == enc._encode_single_piece(w)


def test_bpe_with_ranks_that_need_stepping_back():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260, b"aa": 261, b"aaa": 262}
    own = bpe.Bpe(ranks, r"\S+")

    def merged(w):
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            best = min((ranks.get(a + b, 999), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (999, 0)
            if best[0] == 999:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rnd = random.Random(1)
    for _ in range(4000):
        w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 14)))
        assert own.encode_word(w) == merged(w), w


DOCS = [(5, "Hello there, world."), (1, None), (2, ""), (9, "word " * 3000), (7, "é ß 中文\n\nnew"), (7, "same id"), (None, "no id"), (3, "Hello there, world.")]


def docs(spark):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in DOCS], "doc_id long, text string, start string, length string")


def test_digest_of_nulls_repeats_and_clashing_columns(spark):
    import hashlib

    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = []
    for k, text in DOCS:
        ids = whole.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.digest(docs(spark).repartition(3), path, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.digest(docs(spark).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_records_round_trip(spark):
    path = P.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    memo = tokenizing.ChunkMemo(tokenizing.word_level_encoder(path))
    folder = workspace.new_path(spark, "test-records")

    def encode(texts):
        return tokenizing.memo(("word", path), lambda: tokenizing.word_level_encoder(path)).ids([tokenizing.plain_chunks(x) for x in texts])

    del memo
    records.write_records(docs(spark), folder, encode, 1, wide=False, file_bytes=4000)
    got = {(r["doc_id"], r["ids_crc32"]): r for r in records.read_digest(spark, folder, wide=False).collect()}
    start = 0
    assert len(got) == len(DOCS)
    for k, text in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        row = got[k, zlib.crc32(np.array(ids, "<u4").tobytes())]
        assert row["n_tokens"] == len(ids)
        if k != 7:
            assert row["start"] == start
        start += len(ids)
    # The index leads to any record without reading those before it.
    files = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in records.read_files(spark, folder).collect()}
    assert len(files) > 1
    for r in records.read_index(spark, folder).collect():
        key, ids = records.read_at(files[r["file"]], r["offset"], wide=False)
        assert key == r["doc_id"] and len(ids) == r["n_tokens"] and ids[-1] == 1
    empty = workspace.new_path(spark, "test-empty")
    records.write_records(docs(spark).limit(0), empty, encode, 1, wide=True)
    assert records.read_digest(spark, empty, wide=True).count() == 0


def test_starts_follow_the_numbers_of_files_not_their_names(spark, tmp_path):
    """part-100000 comes after part-99999, and repeated keys are spread over files."""
    import os

    folder = f"{tmp_path}/r"
    encode = lambda texts: (np.concatenate([np.arange(len(x)) for x in texts] or [np.zeros(0)]).astype(np.uint32), np.cumsum([0, *map(len, texts)]))
    rows = [(7, "x" * (i % 9)) for i in range(400)] + [(i, "yy") for i in range(8, 12)]
    records.write_records(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{folder}", encode, 1, wide=False, file_bytes=1500)
    own = sorted(f for f in os.listdir(f"{folder}/records") if f.startswith("part-"))
    assert len(own) > 3
    index = records.read_index(spark, f"file://{folder}").toPandas()
    renamed = {f: f.replace(f[:10], f"part-{99999 + i}") for i, f in enumerate(own)}
    for f, g in renamed.items():
        os.rename(f"{folder}/records/{f}", f"{folder}/records/{g}")
        if os.path.exists(f"{folder}/records/.{f}.crc"):
            os.remove(f"{folder}/records/.{f}.crc")
    index["file"] = index["file"].map(renamed)
    spark.createDataFrame(index, records.INDEX).write.mode("overwrite").parquet(f"file://{folder}/index2")
    os.rename(f"{folder}/index", f"{folder}/old")
    os.rename(f"{folder}/index2", f"{folder}/index")
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in records.read_digest(spark, f"file://{folder}", wide=False).collect())
    at = 0
    for start, n, _ in got:
        assert start == at
        at += n
    assert len(got) == len(rows) and [k for _, _, k in got] == sorted(k for k, _ in rows)


def test_a_broken_record_is_noticed():
    data = bytearray(records.frame(b"payload") + b"\n" + records.frame(b"next") + b"\n")
    assert [bytes(p) for _, p in records.frames(bytes(data))] == [b"payload", b"next"]
    for at in (0, 9, 14, 20):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))


def test_fullest_is_the_best_subset_sum():
    rnd = random.Random(3)
    for _ in range(300):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + i * x for s in sums for i in range(n + 1) if s + i * x <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)


def test_packing_uses_every_piece_once_and_few_bins():
    rnd = random.Random(4)
    counts = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(40)}
    out = packing.pack(counts, 64)
    used = {}
    for combination, times in out:
        assert sum(combination) <= 64
        for x in combination:
            used[x] = used.get(x, 0) + times
    first_fit: list[int] = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, free in enumerate(first_fit) if free >= x), len(first_fit))
        first_fit[at : at + 1] = [(first_fit[at] if at < len(first_fit) else 64) - x]
    assert used == counts and sum(t for _, t in out) <= len(first_fit)
    assert packing.pack({}) == [] and packing.cut(0) == [] and packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)]


def test_packed_documents_fill_sequences_without_gaps(spark):
    encode = packing.encoder(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs(spark).repartition(3), encode, 2, capacity=64).collect()
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for k, x in DOCS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(map(repr, want))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs(spark).limit(0), encode, 2).count() == 0
