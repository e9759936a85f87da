"""What the operators of this subpackage share: Arrow batch mapping, folds, samples and lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: A word is a run of anything but these six ASCII white-space characters; bytes.split() cuts at exactly them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read only through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: a lost executor costs no recomputation, the lineage ends."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there. Unlike a checkpoint it takes its size from its
    files: estimates that joins multiply end here, which matters where rounds of joins follow each other."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_encoders() -> None:
    """Frees what tokenizing tasks have left in this Python worker."""
    tokens = sys.modules.get(f"{__package__}._tokens")
    if tokens is not None:
        tokens._ENCODERS.clear()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], ddl: str, tokenizes: bool = False) -> DataFrame:
    """make() runs once a task and gives a function from a batch to columns (name -> list or array) of the result."""
    ship(df.sparkSession)
    schema = StructType.fromDDL(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not tokenizes:
            drop_encoders()
        arrow, of = to_arrow_schema(schema), make()
        for batch in batches:
            for part in slices(batch):
                out = of(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, for which the function that make() gives says True."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        of = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(of(part), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in row ranges of about `most` bytes, so that Python objects of one range at a time are alive."""
    rows = batch.num_rows
    step = max(1, int(rows * most / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(ids: np.ndarray) -> np.ndarray:
    """XXH64 of longs with seed 42, as Spark's xxhash64 gives it, unsigned."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (np.uint64(42 + 8) + _P5) ^ (turn(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class IdSet:
    """Ids as a bitmap of their hashes, 16 bits an id or more: it has every id of the set and at most one in sixteen
    others, which an exact join takes out afterwards. It spares rows of texts a shuffle. made() gives none for more than
    MOST ids (a bitmap of 32 MB); the caller then joins by id alone."""

    MOST, PART = 1 << 24, 1 << 15

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def made(cls, ids: DataFrame) -> IdSet | None:
        """ids: one column of longs, no nulls."""
        n = ids.count()
        if n > cls.MOST:
            return None
        size = max(cls.PART, 1 << (16 * max(n, 1) - 1).bit_length())
        place = F.xxhash64(ids[ids.columns[0]]).bitwiseAND(F.lit(size - 1))
        parts = ids.select(F.floor(place / cls.PART).cast("int").alias("part"), (place % cls.PART).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
        bits = np.zeros(size // 8, np.uint8)
        for r in parts:
            bits[r.part * cls.PART // 8 : (r.part + 1) * cls.PART // 8] = np.frombuffer(bytes(r.bits), np.uint8)
        return cls(bits)

    def holds(self, ids: pa.Array) -> np.ndarray:
        """For each id whether it may be in the set; False for null."""
        at = (hashed(ids.fill_null(0).to_numpy(zero_copy_only=False)) & self.mask).astype(np.int64)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", doc_id: str = "doc_id", max_bytes: int = 1 << 18) -> list[tuple[str, int]]:
    """At most per_class (text, label) of each class 0 and 1, the ids with the smallest hashes, texts of at most max_bytes.

    The ids are picked from the narrow labels table (a top-k, no shuffle of texts) and reach the text scan as a
    broadcast of at most 2 * per_class rows. Of rows that share an id the smallest text counts, so a repeated id can't
    widen the sample. Rows with a null id or label are no candidates.
    """
    ids = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where("i is not null and y in (0, 1)").distinct()
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
        .where(F.col("t").isNotNull() & (F.octet_length("t") <= max_bytes))
        .join(F.broadcast(picked), "i")
        .groupBy("i", "y")
        .agg(F.min("t").alias("t"))
        .collect()
    )
    return [(r.t, int(r.y)) for r in sorted(rows, key=lambda r: (r.i, r.t, r.y))]


def logistic(x: list[list[float]], y: list[int], ridge: float = 1e-3, steps: int = 50, balance: bool = False):
    """Weights (last: intercept) of a ridge logistic regression by Newton's method; exact enough after 50 steps."""
    import numpy as np

    a = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    t = np.asarray(y, float)
    k = np.ones(len(t))
    if balance and 0 < t.sum() < len(t):
        k = np.where(t > 0, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
    w = np.zeros(a.shape[1])
    penalty = ridge * len(t) * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (k * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(h, a.T @ (k * (p - t)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
