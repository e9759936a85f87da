"""Token-ID output: documents compressed one by one with a shared zstandard dictionary, with an index of offsets.

Format. A store is a folder with two Parquet tables, so that any file system Spark writes to will do.
`dictionary` has one row: the dictionary, its XXH64, the bytes of an id (2 or 4), the end id. `segments` has
self-contained binary segments of up to SEGMENT_DOCS documents and about SEGMENT_BYTES bytes:

    magic "TSG1" | id width u8 | dictionary hash u64 | n u32
    ids of documents i64 * n | null flags u8 * n | numbers of tokens u64 * n | frame ends u64 * n | frames

all little-endian. A frame is one document's serialized id array, compressed with the dictionary alone; a reader of
one document needs the index and that frame. Segments are in ascending doc_id order: (part, seq) orders them, and
`first_token` counts the ids of the part before a segment. The dictionary is trained on a bounded sample of documents
(the SAMPLE smallest id hashes, arrays of up to SAMPLE_BYTES), everything else covers all documents.

Defined cases: null and empty texts are the end id alone; null ids come first; rows with equal ids are ordered by
their text's hash; an empty table is a store without segments.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import map_batches, shared_dir, ship, slices
from ._tokens import encoder

MAGIC = b"TSG1"
HEADER = struct.Struct("<4sBQI")
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 1 << 20
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
LEVEL = 3


def dictionary_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 0)


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _wide(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def write_segment(rows: list[tuple[int | None, int, bytes]], width: int, hash_: int) -> bytes:
    """rows: (doc_id, n_tokens, frame)."""
    n = len(rows)
    keys = np.array([r[0] or 0 for r in rows], "<i8").tobytes()
    null = bytes(r[0] is None for r in rows)
    counts = np.array([r[1] for r in rows], "<u8").tobytes()
    ends = np.cumsum([len(r[2]) for r in rows]).astype("<u8").tobytes()
    return HEADER.pack(MAGIC, width, hash_, n) + keys + null + counts + ends + b"".join(r[2] for r in rows)


class Segment:
    """Index and frames of one segment."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, self.width, hash_, n = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if hash_ != dictionary_hash(dictionary):
            raise ValueError("the segment was written with another dictionary")
        self.raw, at = raw, HEADER.size
        keys = np.frombuffer(raw, "<i8", n, at).tolist()
        null = raw[at + 8 * n : at + 9 * n]
        self.doc_ids = [None if z else k for k, z in zip(keys, null, strict=True)]
        self.n_tokens = np.frombuffer(raw, "<u8", n, at + 9 * n).tolist()
        self.ends = np.frombuffer(raw, "<u8", n, at + 17 * n).tolist()
        self.frames = at + 25 * n
        self.of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document as little-endian unsigned 32-bit integers."""
        a, b = self.ends[k - 1] if k else 0, self.ends[k]
        size = self.n_tokens[k] * self.width
        return _wide(self.of(self.raw[self.frames + a : self.frames + b], max_output_size=size), self.width)


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int, dict_bytes: int, text: str, doc_id: str) -> bytes:
    """A dictionary of serialized id arrays, or a short fixed one where there is too little to train on."""
    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").orderBy(F.xxhash64("i"), "i").limit(SAMPLE)
    sample = docs.select(docs[doc_id].alias("i"), docs[text].alias("t")).join(F.broadcast(ids.distinct()), "i", "left_semi")
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tool = encoder(tokenizer)
        return lambda batch: {"i": batch.column("i"), "raw": [_narrow(x + end, width)[:SAMPLE_BYTES] for x in tool.encode(batch.column("t"))]}

    rows = sorted((r.i, bytes(r.raw)) for r in map_batches(sample, make, "i long, raw binary", tokenizes=True).groupBy("i").agg(F.min("raw").alias("raw")).collect())
    try:
        return zstandard.train_dictionary(dict_bytes, [r[1] for r in rows], level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\x00" * 7 + b"\x01" * 9


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, dict_bytes: int = 112 << 10, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the store of all rows of docs to path, a folder that does not exist."""
    spark = docs.sparkSession
    top = max(encoder(tokenizer).tokenizer.get_vocab_size() - 1, end_id)
    width = 2 if top < 1 << 16 else 4
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    raw = train(docs, tokenizer, end_id, width, dict_bytes, "text", "doc_id")
    hash_ = dictionary_hash(raw)
    spark.createDataFrame([(raw, f"{hash_:016x}", width, end_id)], "dictionary binary, hash string, id_bytes int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")
    ship(spark)
    tool, end = spark.sparkContext.broadcast(raw), np.array([end_id], "<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        d = zstandard.ZstdCompressionDict(tool.value)
        d.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=d).compress
        enc, part, seq, first, rows, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            nonlocal seq, first, rows, size
            n = sum(r[1] for r in rows)
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (first, pa.int64()), (len(rows), pa.int32()), (n, pa.int64()), (rows[0][0], pa.int64()), (rows[-1][0], pa.int64()), (write_segment(rows, width, hash_), pa.binary()))], names=["part", "seq", "first_token", "n_docs", "n_tokens", "first_doc", "last_doc", "segment"])
            seq, first, rows, size = seq + 1, first + n, [], 0
            return out

        for batch in batches:
            for b in slices(batch):
                for key, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                    ids += end
                    rows.append((key, len(ids) // 4, press(_narrow(ids, width))))
                    size += len(rows[-1][2])
                    if len(rows) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                        yield flush()
        if rows:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "_tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_tie", "text")
    dealt.select("doc_id", "text").mapInArrow(run, "part int, seq int, first_token long, n_docs int, n_tokens long, first_doc long, last_doc long, segment binary").write.option("compression", "none").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of the store, from its
    files, with its ids (binary, little-endian unsigned 32-bit) if wanted."""
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    segments = spark.read.parquet(f"{path}/segments")
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a part
    base, at = {}, 0
    for r in totals:
        base[r.part], at = at, at + r.n
    tool = spark.sparkContext.broadcast((raw, base))

    def make():
        raw, base = tool.value

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))}
            for part, first, blob in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                s, start = Segment(blob, raw), base[part] + first
                for k, key in enumerate(s.doc_ids):
                    ids = s.ids(k)
                    for name, x in (("doc_id", key), ("start", start), ("n_tokens", s.n_tokens[k]), ("ids_crc32", zlib.crc32(ids))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(ids)
                    start += s.n_tokens[k]
            return out

        return of

    return map_batches(segments.select("part", "first_token", "segment"), make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> bytes | None:
    """The ids of one document; only segments whose range covers it are read."""
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    for r in spark.read.parquet(f"{path}/segments").where((F.col("last_doc") >= doc_id) & (F.coalesce("first_doc", F.lit(doc_id)) <= doc_id)).select("segment").toLocalIterator():
        s = Segment(bytes(r.segment), raw)
        if doc_id in s.doc_ids:
            return s.ids(s.doc_ids.index(doc_id))
    return None


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
