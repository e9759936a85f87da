"""Stupid-backoff language-model scores, computed relationally.

    S(w | context) = c(context w) / c(context) if the n-gram was seen, else ALPHA * S(w | shorter context)

with c(w) / N at the end, and ALPHA / N for a word never seen. Scored against its own corpus, a text's own n-grams do
not count for it. The counts cover every word of every text.

The join of exploded n-grams with the count tables runs on hash partitions of packed columns:

1. blocks: texts become word numbers in blocks of about BLOCK words, written once to the shared folder;
2. n-grams: a block's distinct n-grams of each order (64-bit hashes, with counts) are dealt by hash into buckets;
3. counts: a bucket adds up the counts of its n-grams over all blocks and answers every block with the sums;
4. scores: a block lays the sums at its words' places and adds up each text.

A block sends an n-gram once however often it has it, so the commonest n-gram is one entry a block in its bucket; hot
keys need nothing else. Buckets are as many as keep a bucket's entries near ENTRIES at any corpus size.

Defined cases: null, empty and blank texts have no words and score 0; rows with null ids and repeated rows are scored
like others (a row's own n-grams are the row's); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._base import shared_dir, ship, slices

ALPHA = 0.4
BLOCK = 1_500_000
ENTRIES = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTED, SCORED = 1, 2


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as zstandard-compressed byte planes; sorted ones are best given as differences."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes() if len(numbers) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _blocks(docs: DataFrame, role: int, text: str, doc_id: str) -> DataFrame:
    """block, role, n_words, doc_ids, lengths (int32), vocabulary (hashes), words (numbers in it, packed); binary columns."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        keys, lengths, numbers, known, total = [], [], [], {}, 0

        def flush():
            nonlocal seq, keys, lengths, numbers, known, total
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
            row = {"block": (role << 56) | (task << 24) | seq, "role": role, "n_words": total, "doc_ids": keys, "lengths": np.array(lengths, np.int32).tobytes(), "vocabulary": hashes.tobytes(), "words": packed(np.concatenate(numbers) if numbers else np.zeros(0, np.uint32))}
            seq, keys, lengths, numbers, known, total = seq + 1, [], [], [], {}, 0
            return row

        def batch_of(row):
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                for key, t in zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True):
                    words = t.encode("utf-8", "replace").split() if t else []
                    number = known.setdefault
                    numbers.append(np.fromiter((number(w, len(known)) for w in words), np.uint32, len(words)))
                    keys.append(key)
                    lengths.append(len(words))
                    total += len(words)
                    if total >= BLOCK:
                        yield batch_of(flush())
        if keys:
            yield batch_of(flush())

    ddl = f"block long, role int, n_words long, doc_ids array<{kind}>, lengths binary, vocabulary binary, words binary"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    return docs.select(docs[doc_id].alias("i"), docs[text].alias("t")).mapInArrow(run, ddl)


class Block:
    """The n-grams of a block. of[n]: for each word the number, in the sorted distinct n-grams, of the n-gram that ends
    there, -1 where its text has not begun n - 1 words before."""

    def __init__(self, lengths: bytes, vocabulary: bytes, words: bytes, order: int):
        self.lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
        hashes = np.frombuffer(vocabulary, np.uint64)[unpacked(words, np.uint32)]
        n = len(hashes)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.place = (np.arange(n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)).astype(np.int32)
        self.grams, self.counts, self.of = {}, {}, {}
        now = hashes
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([np.zeros(1, np.uint64), now[:-1]]) if n else now
                now = (before ^ (before >> np.uint64(29))) * _MIX + hashes
                now = (now ^ (now >> np.uint64(32))) * _MIX
            else:
                now = hashes * _MIX
                now = now ^ (now >> np.uint64(31))
            ok = self.place >= k - 1
            self.grams[k], inverse, self.counts[k] = np.unique(now[ok], return_inverse=True, return_counts=True)
            self.of[k] = np.full(n, -1, np.int32)
            self.of[k][ok] = inverse

    def own(self, k: int) -> np.ndarray:
        """How often each word's n-gram of order k is in its text."""
        out = np.zeros(len(self.doc), np.int64)
        ok = self.of[k] >= 0
        key = self.doc[ok].astype(np.int64) * (len(self.grams[k]) + 1) + self.of[k][ok]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        out[ok] = times[inverse]
        return out

    def scores(self, totals: dict[int, np.ndarray], words: int, leave_out: bool, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum of natural log scores and number of words that backed off, for each text."""
        order = max(self.grams)
        c = {}
        for k in range(1, order + 1):
            c[k] = np.where(self.of[k] >= 0, totals[k][np.maximum(self.of[k], 0)] if len(totals[k]) else 0, 0) - (self.own(k) if leave_out else 0)
        size = np.maximum(words - (np.repeat(self.lengths, self.lengths) if leave_out else np.zeros(len(self.doc), np.int64)), 1)
        log, todo, penalty = np.zeros(len(self.doc)), np.ones(len(self.doc), bool), np.zeros(len(self.doc))
        backed = np.zeros(len(self.doc), bool)
        for k in range(order, 0, -1):
            valid = self.place >= k - 1
            hit = todo & valid & (c[k] > 0)
            context = np.concatenate([[0], c[k - 1][:-1]]) if k > 1 else size
            log[hit] = np.log(c[k][hit] / context[hit]) + penalty[hit]
            todo &= ~hit
            miss = todo & valid
            backed |= miss
            penalty[miss] += np.log(alpha)
        log[todo] = penalty[todo] - np.log(size[todo])
        n = len(self.lengths)
        return np.bincount(self.doc, log, n)[:n], np.bincount(self.doc, backed, n)[:n].astype(np.int64)


def score(docs: DataFrame, reference: DataFrame | None = None, order: int = 2, alpha: float = ALPHA, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), n_backed_off of every row of docs, against the counts of
    reference, or of docs itself without what each row counts by itself."""
    leave_out = reference is None
    ship(docs.sparkSession)
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    kind = docs.schema[doc_id].dataType.simpleString()
    made = _blocks(docs, SCORED | (COUNTED if reference is None else 0), text, doc_id)
    made.write.parquet(path)
    if reference is not None:
        _blocks(reference, COUNTED, text, doc_id).write.mode("append").parquet(path)
    blocks = spark.read.parquet(path)
    words = blocks.where(F.col("role").bitwiseAND(COUNTED) > 0).agg(F.sum("n_words")).first()[0] or 0
    every = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every * order // ENTRIES))

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, role, lengths, vocabulary, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "lengths", "vocabulary", "words")), strict=True):
                b = Block(lengths, vocabulary, numbers, order)
                for k, grams in b.grams.items():
                    edges = np.searchsorted((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                    counts = b.counts[k].astype(np.uint32) if role & COUNTED else np.zeros(len(grams), np.uint32)
                    parts = [(x, a, z) for x, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([role] * len(parts), pa.int32()), pa.array([k] * len(parts), pa.int32()), pa.array([packed(np.diff(grams[a:z], prepend=np.uint64(0))) for _, a, z in parts], pa.binary()), pa.array([packed(counts[a:z]) for _, a, z in parts], pa.binary())], names=["bucket", "block", "role", "n", "grams", "counts"])

    def add_up(rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for k in range(1, order + 1):
            mine = [r for r in rows.filter(pa.compute.equal(rows.column("n"), k)).to_pylist()]
            if not mine:
                continue
            grams = [np.cumsum(unpacked(r["grams"], np.uint64), dtype=np.uint64) for r in mine]
            _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([unpacked(r["counts"], np.uint32) for r in mine])).astype(np.int64)
            at = 0
            for r, g in zip(mine, grams, strict=True):
                if r["role"] & SCORED:
                    for column, x in zip(out, (r["block"], k, r["bucket"], packed(total[inverse[at : at + len(g)]])), strict=True):
                        column.append(x)
                at += len(g)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "n", "bucket", "totals"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows:
            (row,) = left.to_pylist()
            b, totals = Block(row["lengths"], row["vocabulary"], row["words"], order), {}
            answers = sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
            for k in range(1, order + 1):
                totals[k] = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["totals"], np.int64) for r in answers if r["n"] == k)])
            log, backed = b.scores(totals, words, leave_out, alpha)
            out = [row["doc_ids"], b.lengths, log, backed]
        types = left.schema.field("doc_ids").type.value_type, pa.int64(), pa.float64(), pa.int64()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "n_words", "log_score", "n_backed_off"])

    chunks = blocks.select("block", "role", "lengths", "vocabulary", "words").mapInArrow(deal, "bucket int, block long, role int, n int, grams binary, counts binary")
    answers = chunks.groupBy("bucket").applyInArrow(add_up, "block long, n int, bucket int, totals binary")
    asked = blocks.where(F.col("role").bitwiseAND(SCORED) > 0).select("block", "doc_ids", "lengths", "vocabulary", "words")
    return asked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_words long, log_score double, n_backed_off long")
