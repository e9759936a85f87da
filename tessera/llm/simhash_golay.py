"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles. Fingerprints
link at `MOST` = 2 or fewer differing bits; classes are the connected components.

Candidates. The 64 bits are three segments of 22, 21 and 21 bits. Of two differing bits at most two segments are
touched, so one segment is equal (pigeonhole), and the segment after it differs in at most two bits. The binary Golay
code (23, 12, 7) is perfect: every 23-bit word lies within three bits of exactly one codeword. The codewords that a
segment or one of its 23 neighbours decodes to (one or six) are its fuzzy keys: two segments that differ in at most
two bits have a word within one bit of both, hence a key in common. A join key is (which segment is equal, its bits,
a fuzzy key of the next): about 33 bits, at most 18 keys a fingerprint, no pair within two bits missed.

Only distinct fingerprints take part, so copies of any number cost one row. A key shared by up to `BUCKET`
fingerprints is joined with itself and verified bit by bit. The fingerprints of a larger one take an exact way whose
groups can't grow: two fingerprints within two bits share a centre within one bit of both, and at most 65
fingerprints lie around a centre; all of them are linked to the smallest. That is 65 rows a fingerprint, never a
square.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; rows with a null id get their fingerprint's class (null if it has no other row) and
never join classes; rows that share an id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut, map_batches
from .components import connected_components

SEED = 42
#: The code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and the segments' widths.
GENERATOR = 0b101011100011
SEGMENTS = (22, 21, 21)
MOST = 2
BUCKET = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, unsigned. A-Z are lower-cased; shingles are `width` words, space-joined, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [e - len(w) for e, w in zip(ends, words, strict=True)]
    of = xxhash.xxh64_intdigest
    if len(words) < width:
        return of(joined, SEED)
    ones, last = np.zeros(64, np.int64), ends[width - 1 :]
    for at in range(0, len(last), 1 << 14):
        h = np.array([of(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(last)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def make():
        def of(batch: pa.RecordBatch) -> dict:
            fps = np.array([fingerprint(t, width) for t in batch.column("t").to_pylist()], np.uint64)
            return {"doc_id": batch.column("i"), "fp": fps.view(np.int64)}

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t")), make, f"doc_id {kind}, fp long")


class Golay:
    """Nearest codeword of 23-bit words, vectorised: the syndrome of a word names its one error pattern of weight 3 or less."""

    def __init__(self):
        one = np.zeros(23, np.int64)  # syndromes of single bits: x^k modulo the generator
        value = 1
        for k in range(23):
            one[k] = value
            value <<= 1
            if value >> 11:
                value ^= GENERATOR
        self.low, self.high = (self._xor_table(one[a:b]) for a, b in ((0, 12), (12, 23)))
        self.error = np.zeros(1 << 11, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    bits = {a, b, c}
                    if len(bits) == 3 or a == b:  # every pattern of weight 1, 2 and 3
                        self.error[np.bitwise_xor.reduce(one[list(bits)])] = sum(1 << x for x in bits)

    @staticmethod
    def _xor_table(values: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for v in values:
            out = np.concatenate([out, out ^ v])
        return out

    def codeword(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.error[self.low[words & 0xFFF] ^ self.high[words >> 12]]

    def fuzzy_keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, information bits of a codeword): one or six a word."""
        near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))], axis=1)
        keys = np.sort(self.codeword(near) >> 11, axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        return np.nonzero(new)[0], keys[new]


def fuzzy_rows(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, join key) of every key of every fingerprint (unsigned)."""
    parts, shift = [], np.uint64(0)
    for wide in SEGMENTS:
        parts.append(((fps >> shift) & np.uint64((1 << wide) - 1)).astype(np.int64))
        shift += np.uint64(wide)
    at, keys = [], []
    for i, exact in enumerate(parts):
        where, code = golay.fuzzy_keys(parts[(i + 1) % len(parts)])
        at.append(where)
        keys.append((i << 34) | (exact[where] << 12) | code)
    return np.concatenate(at), np.concatenate(keys)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """nodes: fp, node (both long, fp distinct). Returns u, v: every pair within MOST bits is connected by them."""

    def make():
        golay = Golay()

        def of(batch: pa.RecordBatch) -> dict:
            fps, ids = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            at, keys = fuzzy_rows(fps.view(np.uint64), golay)
            return {"key": keys, "fp": fps[at], "node": ids[at]}

        return of

    rows = cut(map_batches(nodes, make, "key long, fp long, node long"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(sizes, "key"))
    few = shared.where(F.col("n") <= bucket)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST))
    near = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    many = shared.where(F.col("n") > bucket).select("fp", "node").distinct()
    centres = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    around = many.select("node", F.explode(centres).alias("centre")).groupBy("centre").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    stars = around.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v"))
    return near.unionByName(stars).where("u <> v").distinct()


def classes(fps: DataFrame) -> DataFrame:
    """fps: doc_id, fp. Returns fp, component (smallest doc_id of the class), one row a fingerprint."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = connected_components(links(nodes.where("node is not null")))
    return nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id of every row. doc_id must be a long."""
    fps = cut(fingerprints(docs, width, text, doc_id))
    return fps.join(classes(fps), "fp", "left").select("doc_id", "fp", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, one of each class: its smallest id's. Rows with a null id stay, since nothing
    names them. Of several rows with the kept id, one stays."""
    fps = cut(fingerprints(docs, width, text, doc_id))
    near = fps.join(classes(fps), "fp", "left")
    first = cut(near.where("doc_id = component").groupBy("doc_id").agg(F.count("*").alias("rows")))
    kept = docs.join(first, docs[doc_id] == first["doc_id"], "left_semi")
    if not first.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id])
    return kept.unionByName(docs.where(docs[doc_id].isNull()))
