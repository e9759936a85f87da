"""Language identification by nearest centroid.

A text is the vector of its byte trigrams (lower-cased, ASCII other than letters as spaces, runs of spaces as one), weighted by
(1 + log count) * idf and normalised to length 1. Training clusters each language's vectors by spherical k-means; a
text gets the language of the centroid with the largest cosine. It is rejected where that cosine lies below what all
but `outlier` of the cluster's own training vectors reach, less a margin.

The model is fitted on a bounded sample (`per_lang` rows a language, the smallest id hashes among rows drawn by hash);
its vocabulary has `features` trigrams, so the broadcast model has a fixed size a language. Scoring is one narrow pass
over whole texts: trigram codes index a table of features, a bincount is the vector.

Defined cases: a text that is null or has no letter is `und` with score 0; a text none of whose trigrams is known
falls to the most frequent language with score 0; without training rows every text is `und`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_batches

#: ASCII that is no letter says nothing about a language and becomes a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> np.ndarray:
    """Codes of 24 bits of all byte trigrams of the whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]


@dataclass
class CentroidModel:
    codes: np.ndarray  # sorted codes of the features
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    langs: list[str]  # of each row
    least: np.ndarray  # cosine below which a row rejects

    def table(self) -> np.ndarray:
        """Code to feature number; unknown codes get the number after the last."""
        out = np.full(1 << 24, len(self.codes), np.uint16)
        out[self.codes] = np.arange(len(self.codes))
        return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    size = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return (v / np.maximum(size, 1e-12)).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Number of the cluster of each unit row; seeded by the farthest rows, so the same rows give the same clusters."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centres = x[picked]
    of = np.zeros(len(x), int)
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return of


def fit_rows(rows: list[tuple[str, str]], features: int = 8192, clusters: int = 4, outlier: float = 0.01, margin: float = 0.1) -> CentroidModel | None:
    """From (text, language) rows."""
    rows = [(t, lang) for t, lang in rows if _LETTER.search(t)]
    if not rows:
        return None
    docs = [np.unique(trigrams(t), return_counts=True) for t, _ in rows]
    codes, df = np.unique(np.concatenate([c for c, _ in docs]), return_counts=True)
    top = np.sort(np.argsort(-df, kind="stable")[: min(features, 65535)])
    codes, idf = codes[top], np.log((1 + len(rows)) / (1 + df[top])) + 1
    counts = np.zeros((len(rows), len(codes)), np.float32)
    for k, (c, n) in enumerate(docs):
        at = np.searchsorted(codes, c)
        at[at == len(codes)] = 0
        ok = codes[at] == c
        counts[k, at[ok]] = n[ok]
    x = weigh(counts, idf)
    centroids, langs, least = [], [], []
    names = np.array([lang for _, lang in rows])
    for lang in sorted(set(names), key=lambda v: (-(names == v).sum(), v)):
        mine = x[names == lang]
        of = spherical_kmeans(mine, clusters)
        for c in sorted(set(of)):
            centre = mine[of == c].sum(axis=0)
            centre /= max(np.linalg.norm(centre), 1e-12)
            centroids.append(centre)
            langs.append(str(lang))
            least.append(float(np.quantile(mine[of == c] @ centre, outlier)) - margin)
    return CentroidModel(codes, idf, np.stack(centroids).astype(np.float32), langs, np.array(least))


def sample(docs: DataFrame, per_lang: int, text: str, lang: str, doc_id: str, max_bytes: int = 1 << 18) -> list[tuple[str, str]]:
    """At most per_lang rows of each language, texts of at most max_bytes. A count a language comes first; then rows
    are drawn by the hash of their id with a chance that yields about twice the bound, so no language is gathered."""
    ok = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    counts = {r.l: r["count"] for r in ok.groupBy("l").count().collect()}
    if not counts:
        return []
    chance = None
    for key, n in sorted(counts.items()):
        chance = (F if chance is None else chance).when(F.col("l") == key, float(min(1.0, 2 * per_lang / n)))
    u = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / float(1 << 30)
    rows = ok.where((u < chance.otherwise(0.0)) & (F.octet_length("t") <= max_bytes)).select(u.alias("u"), "t", "l").distinct().collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r.u, r.t, r.l)):
        taken[r.l] = taken.get(r.l, 0) + 1
        if taken[r.l] <= per_lang:
            out.append((r.t, r.l))
    return out


def fit(docs: DataFrame, per_lang: int = 400, features: int = 8192, clusters: int = 4, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> CentroidModel | None:
    return fit_rows(sample(docs, per_lang, text, lang, doc_id), features, clusters)


class Predictor:
    def __init__(self, model: CentroidModel):
        self.model, self.table = model, model.table()

    def vector(self, text: str) -> np.ndarray:
        n = len(self.model.codes)
        return weigh(np.bincount(self.table[trigrams(text)], minlength=n + 1)[:n], self.model.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(nearest language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        at = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        if at:
            cos = np.stack([self.vector(texts[k]) for k in at]) @ self.model.centroids.T
            best = cos.argmax(axis=1)
            for k, b, c in zip(at, best, cos[np.arange(len(at)), best], strict=True):
                out[k] = (self.model.langs[b], float(min(max(c, 0.0), 1.0)), bool(c < self.model.least[b]))
        return out


def identify(docs: DataFrame, model: CentroidModel | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred (und where rejected), nearest, score (cosine), rejected of every row."""
    tool = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        p = Predictor(tool.value) if tool.value else None

        def of(batch: pa.RecordBatch) -> dict:
            texts = batch.column("t").to_pylist()
            got = [("und", 0.0, True)] * len(texts) if p is None else [x for k in range(0, len(texts), 256) for x in p.predict(texts[k : k + 256])]
            return {"doc_id": batch.column("i"), "lang_pred": ["und" if r else g for g, _, r in got], "nearest": [g for g, _, _ in got], "score": [s for _, s, _ in got], "rejected": [r for _, _, r in got]}

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t")), make, f"doc_id {kind}, lang_pred string, nearest string, score double, rejected boolean")
