"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into pieces of
CHUNK bytes (all of them, to the end: a dictionary only helps near its use, so one long frame would forget it), each
piece is compressed with either dictionary, and the normalised size difference

    d = (bytes with the bad dictionary - bytes with the good one) / (their sum)

summed over the pieces becomes the probability of label 1 by a logistic calibration on rows that trained no
dictionary; the calibration also knows r = the good dictionary's bytes a byte of text, which is tiny for a text that
repeats itself. Empty and null texts get the calibrated score of d = 0 at a usual r. Scoring is one narrow pass
without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._base import filter_batches, labelled_sample, logistic, map_batches

CHUNK = 2048
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors with digested dictionaries, made once a task."""

    def __init__(self, model: CompressionModel):
        self.tools = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        self.weights = model.weights

    def sizes(self, text: str | None) -> tuple[float, float]:
        """d and r of the module's text; an empty text has d = 0 and r = 0.4."""
        raw = (text or "").encode("utf-8", "replace")
        good, bad = self.tools
        g = b = 0
        for at in range(0, len(raw), CHUNK):
            piece = raw[at : at + CHUNK]
            g += len(good(piece))
            b += len(bad(piece))
        return ((b - g) / (b + g), min(1.0, g / len(raw))) if raw else (0.0, 0.4)

    def calibrated(self, d: float, r: float) -> float:
        z = self.weights[0] * d + self.weights[1] * r + self.weights[2]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def score(self, text: str | None) -> float:
        return self.calibrated(*self.sizes(text))


def fit_rows(rows: list[tuple[str, int]], dict_bytes: int = 128 << 10) -> CompressionModel | None:
    """From (text, label) rows. Every third row of a class calibrates, the rest trains its dictionary. None if a class is missing."""
    by = {y: [t.encode("utf-8", "replace") for t, label in rows if label == y and t] for y in (0, 1)}
    if not by[0] or not by[1]:
        return None
    dicts = {}
    for y, texts in by.items():
        train = [t for i, t in enumerate(texts) if i % 3] or texts
        pieces = [t[at : at + CHUNK] for t in train for at in range(0, len(t), CHUNK)]
        try:
            dicts[y] = zstandard.train_dictionary(dict_bytes, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples to train on: raw content serves as the dictionary
            dicts[y] = b"".join(pieces)[-dict_bytes:].ljust(8, b" ")
    plain = Scorer(CompressionModel(dicts[1], dicts[0], (0.0, 0.0, 0.0)))
    x, y = [], []
    for label, texts in by.items():
        for t in [t for i, t in enumerate(texts) if i % 3 == 0] or texts:
            x.append(list(plain.sizes(t.decode("utf-8"))))
            y.append(label)
    return CompressionModel(dicts[1], dicts[0], tuple(float(v) for v in logistic(x, y, ridge=1e-5)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, dict_bytes: int = 128 << 10, text: str = "text", doc_id: str = "doc_id") -> CompressionModel | None:
    """per_class: the bound of the labelled sample of each class. None where a class has no row."""
    return fit_rows(labelled_sample(docs, labels, label, per_class, text, doc_id), dict_bytes)


def score(docs: DataFrame, model: CompressionModel | None, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, difference of every row. Without a model every score is 0.5. Null ids stay null, repeated rows repeat."""
    tool = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = tool.value.scorer() if tool.value else None

        def of(batch: pa.RecordBatch) -> dict:
            texts = batch.column("t").to_pylist()
            both = [scorer.sizes(t) if scorer else (0.0, 0.0) for t in texts]
            p = [scorer.calibrated(*x) if scorer else 0.5 for x in both]
            return {"doc_id": batch.column("i"), "score": p, "predicted": [int(v >= threshold) for v in p], "difference": [d for d, _ in both]}

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t")), make, f"doc_id {kind}, score double, predicted int, difference double")


def keep(docs: DataFrame, model: CompressionModel | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; all rows where no model could be trained."""
    tool = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = tool.value.scorer() if tool.value else None
        return lambda batch: [scorer is None or scorer.score(t) >= threshold for t in batch.column(text).to_pylist()]

    return filter_batches(docs, make)
