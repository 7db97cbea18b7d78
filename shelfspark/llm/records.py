"""Token ids as length-delimited binary records, with a separate offset index.

A file is a sequence of records, each
    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 bytes |
    payload | masked checksum of the payload, 4 bytes | one newline byte
all little-endian. A payload is the document's key (8 bytes, signed) and its ids as unsigned 16-bit
integers, or 32-bit ones where the vocabulary needs them. The checksum is CRC-32, rotated by 15 bits
and shifted by a constant as in TFRecord files, so that a checksum of data that holds checksums stays
sound. The newline is the separator of Spark's text writer, which writes the files: committed output
on any Hadoop file system, with no file handled outside Spark.

Files hold keys in ascending order, and so do files by the number in their names. The index is a
Parquet table of (file, key, offset, length, n_tokens): a reader that shuffles records seeks by it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark import workspace

from . import tokenizing

FILE_BYTES = 16_000_000
#: Fixed values of the framing.
MASK_DELTA, HEADER, FOOTER = 0xA282EAD8, 12, 5
NULL_KEY = -(1 << 63)
INDEX = "file string, doc_id long, offset long, length long, n_tokens long"


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its newline."""
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))])


def read_frame(data: memoryview | bytes, offset: int) -> memoryview:
    """The payload of the record at an offset; raises ValueError where a length or checksum is wrong."""
    head = bytes(data[offset : offset + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, offset + 8)[0] != masked_crc(head):
        raise ValueError(f"bad record length at {offset}")
    n = struct.unpack("<Q", head)[0]
    payload = memoryview(data)[offset + HEADER : offset + HEADER + n]
    if len(payload) < n or struct.unpack_from("<I", data, offset + HEADER + n)[0] != masked_crc(payload):
        raise ValueError(f"bad record at {offset}")
    return payload


def _key(payload: memoryview) -> int | None:
    k = struct.unpack_from("<q", payload)[0]
    return None if k == NULL_KEY else k


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record of a file."""
    offset = 0
    while offset < len(data):
        payload = read_frame(data, offset)
        yield offset, payload
        offset += HEADER + len(payload) + FOOTER


def write_records(docs: DataFrame, folder: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, wide: bool, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write folder/records and folder/index.

    encode: ids of some texts, one after another, and where each begins. Null texts count as empty:
    their record holds end_id alone. Rows with equal keys become records of their own; a null key is
    written as the least 64-bit number, comes first and is read as null. An empty table gives no records. Rows are dealt out by ranges of
    the key and, where keys repeat, of their texts' hash, about file_bytes of text each, so that one
    file is one task's work at any input size, whatever key a third of the rows has.
    """
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for ks, texts in tokenizing.slices(batch.column(0), batch.column(1)):
                ids, at = encode(texts)
                own = ids.astype(dtype)
                yield pa.RecordBatch.from_arrays([pa.array([frame(struct.pack("<q", NULL_KEY if k is None else k) + own[a:b].tobytes() + end) for k, a, b in zip(ks, at[:-1], at[1:], strict=True)], pa.binary())], ["frame"])

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    # Rows alike in key and text are told apart by their place, so that no range has to hold them all.
    ranged = rows.repartitionByRange(max(1, -(-total // file_bytes)), "k", F.xxhash64("t"), F.xxhash64(F.monotonically_increasing_id()))
    ranged.sortWithinPartitions("k").select("k", "t").mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{folder}/records")
    read_files(spark, folder).select("path", "content").mapInArrow(_index(2 if not wide else 4), INDEX).write.parquet(f"{folder}/index")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the record files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")


def _index(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(_key(p), at, len(p), (len(p) - 8) // width) for at, p in frames(content.as_py())]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                name = path.as_py().rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["file", "doc_id", "offset", "length", "n_tokens"])

    return run


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_digest(spark: SparkSession, folder: str, wide: bool) -> DataFrame:
    """Read the records back: doc_id, start, n_tokens, ids_crc32.

    Files are read where they lie, record by record, with both checksums verified; start adds the
    tokens of the files before by number, which the index gives.
    """
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                start, rows = 0, []
                for _, payload in frames(content.as_buffer()):
                    ids = np.frombuffer(payload[8:], dtype).astype("<u4")
                    rows.append((_key(payload), start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                name = path.as_py().rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = read_files(spark, folder).select("path", "content").mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    # A row a file, which holds file_bytes of text: files are counted within ranges of a thousand and the ranges before are added.
    sizes = read_index(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("number", F.regexp_extract("file", "part-([0-9]+)", 1).cast("long"))
    sizes = workspace.materialize(sizes.withColumn("block", F.floor(F.col("number") / 1000)), "file_sizes")
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda order: F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = blocks.select("block", before(W.orderBy("block")).alias("earlier"))  # a thousandth of the files in one small task
    first = sizes.withColumn("inside", before(W.partitionBy("block").orderBy("number"))).join(earlier, "block")
    first = workspace.materialize(first.select("file", (F.col("earlier") + F.col("inside")).alias("before")), "file_starts")
    return read.join(workspace.broadcast_if_small(first), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_at(content: bytes, offset: int, wide: bool) -> tuple[int | None, np.ndarray]:
    """Key and ids of the one record at an offset of the index."""
    payload = read_frame(content, offset)
    return _key(payload), np.frombuffer(payload[8:], "<u4" if wide else "<u2")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise all documents, write them as records in ascending doc_id order, read them back."""
    import public_tokenizers as tokenizers

    path = tokenizers.path("word_bpe_49k.json")

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return tokenizing.memo(("word", path), lambda: tokenizing.word_level_encoder(path)).ids([tokenizing.plain_chunks(t) for t in texts])

    folder = workspace.new_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, encode, end_id=1, wide=False)
    return read_digest(spark, folder, wide=False)
