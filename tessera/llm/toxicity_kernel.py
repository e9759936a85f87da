"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a set of units: its lower-cased words without the marks around them, and runs of three or more one-character words joined ("i d i o t").
The kernel of two units counts the character triples and quadruples that both have in this order with gaps, each
weighed by DECAY ** span in either unit and divided by the units' norms. Only the gap patterns of PATTERNS have a weight:
one inserted character anywhere or everywhere, which leaves i.d.i.o.t and id-iot close to idiot, or two in one place.

Training is multiple-instance learning on labelled sentences: all sentences of a non-toxic text are negative; of a toxic text
the sentences are positive that hold a witness, a unit with a character 5-gram or a longer beginning that toxic
texts have surely more often; the commonest are also shown gapped and with inserted characters.
Rounds add the clean units that the last machine took for toxic. Landmarks are witnesses and clean units, picked by pivoted Cholesky steps on their kernel; the Nyström features K_mm^(-1/2) k_m(u) train an
L2 machine with squared hinge loss. Because the truncated kernel has an explicit finite feature map, the trained sum
over landmarks folds into one table over subsequences, and scoring a unit is a sum of table entries.

A text's score is the calibrated probability from its two most toxic units. Scoring is one narrow pass over whole
texts; each distinct word is scored once a task.

Defined cases: texts without units (null, empty, blank) get the score of a text whose units say nothing; without rows
of both labels every score is 0. The fit uses at most `per_class` labelled rows of each class.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import labelled_sample, logistic, map_batches

DECAY = 0.75
#: Steps from one character of a subsequence to the next: all triples of span five or less, quadruples with one
#: character inserted at most once or everywhere.
PATTERNS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4] + [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2), (2, 2, 2)]
#: Codes of triples, then hashes of quadruples.
TRIPLES, CODES = 1 << 18, (1 << 18) + (1 << 20)
#: Windows of a longer unit overlap by half.
LONGEST = 40
MOST_WORDS = 300_000
_EDGE = 26
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SENTENCE = re.compile(r"[.!?\n]+\s")


def _classes(points: np.ndarray) -> np.ndarray:
    """Six-bit classes of code points: a to z, the edge mark, one for all ASCII marks, one for digits, 35 for the rest."""
    letter, digit = (points >= 97) & (points <= 122), (points >= 48) & (points <= 57)
    rest = np.where(digit, 28, np.where(points < 128, 27, 29 + points % 35))
    return np.where(letter, points - 97, np.where(points == 0, _EDGE, rest)).astype(np.int32)


def units_of(text: str | None) -> list[str]:
    """The units of a whole text, repeats included."""
    words = text.lower().split() if text else []
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    if (lengths == 1).sum() >= 3:
        single = np.concatenate([[0], (lengths == 1).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(single))
        words = words + ["".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]
    return words


def bare(unit: str) -> str:
    """A unit without marks at its ends; one of marks alone stays."""
    return unit.strip(_MARKS) or unit


def _windows(units: list[str]) -> tuple[list[str], np.ndarray]:
    """Units, those over LONGEST as overlapping windows, and the unit each belongs to."""
    if all(len(u) <= LONGEST for u in units):
        return units, np.arange(len(units))
    out, of = [], []
    for k, u in enumerate(units):
        for at in range(0, max(1, len(u) - LONGEST // 2), LONGEST // 2) if len(u) > LONGEST else (0,):
            out.append(u[at : at + LONGEST])
            of.append(k)
    return out, np.array(of, int)


def _subsequences(windows: list[str]):
    """For each pattern: codes of subsequences, the window of each, and the weight of the span."""
    lengths = np.fromiter(map(len, windows), np.int64, len(windows)) + 2
    text = "\0" + "\0\0".join(windows) + "\0"
    c = _classes(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"))
    of = np.repeat(np.arange(len(windows)), lengths)
    for steps in PATTERNS:
        span = sum(steps)
        n = len(c) - span
        if n > 0:
            ok = np.flatnonzero(of[:n] == of[span:])
            code, at = c[ok].astype(np.int64), ok
            for step in steps:
                at = at + step
                code = (code << 6) | c[at]
            if len(steps) == 3:
                code = TRIPLES + (((code * 2654435761) >> 7) & ((1 << 20) - 1))
            yield code, of[ok], DECAY ** (span + 1)


def _norms(windows: list[str], parts: list | None = None) -> np.ndarray:
    """The root of each window's kernel with itself: equal subsequences add up before they are squared."""
    parts = list(_subsequences(windows)) if parts is None else parts
    if not parts:
        return np.ones(len(windows))
    keys = np.concatenate([(w << 21) | codes for codes, w, _ in parts])
    sort = np.argsort(keys)
    keys = keys[sort]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(np.concatenate([np.full(len(c), x) for c, _, x in parts])[sort], new)
    return np.sqrt(np.bincount(keys[new] >> 21, sums * sums, len(windows)) + 1e-12)


def table_scores(units: list[str], table: np.ndarray) -> np.ndarray:
    """sum over a unit's subsequences of weight * table / norm; of its windows the largest."""
    if not units:
        return np.zeros(0)
    windows, of = _windows(units)
    total = np.zeros(len(windows))
    parts = list(_subsequences(windows))
    for codes, w, weight in parts:
        total += weight * np.bincount(w, table[codes], len(windows))
    total /= _norms(windows, parts)
    out = np.full(len(units), -np.inf)
    np.maximum.at(out, of, total)
    return out


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of units with landmarks; both at most LONGEST long."""
    codes, owner, values = [], [], []
    for c, w, weight in _subsequences(landmarks):
        codes.append(c)
        owner.append(w)
        values.append(np.full(len(c), weight))
    own, at = np.unique(np.concatenate(codes), return_inverse=True)
    matrix = np.zeros((len(own) + 1, len(landmarks)), np.float32)
    np.add.at(matrix, (at, np.concatenate(owner)), np.concatenate(values))
    place = np.full(CODES, len(own), np.int32)
    place[own] = np.arange(len(own))
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for a in range(0, len(units), 2000):
        part = units[a : a + 2000]
        for c, w, weight in _subsequences(part):
            p = place[c]
            known = p < len(own)
            p, w = p[known], w[known]
            if len(w):  # windows come in order, so a unit's rows are next to each other
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                out[w[first] + a] += weight * np.add.reduceat(matrix[p], first, axis=0)
    return out / _norms(units)[:, None] / _norms(landmarks)[None, :]


def pick_landmarks(units: list[str], most: int) -> list[str]:
    """Pivoted Cholesky: each landmark is the unit that those before explain least; earlier units first among equals."""
    k = kernel(units, units).astype(np.float64)
    left, rows, picked = np.diag(k).copy(), [], []
    while len(picked) < min(most, len(units)):
        at = int(left.argmax())
        if left[at] < 1e-6 * k.max():
            break
        row = (k[at] - sum((r[at] * r for r in rows), np.zeros(len(k)))) / math.sqrt(left[at])
        rows.append(row)
        picked.append(at)
        left = np.maximum(left - row * row, 0)
        left[at] = 0
    return [units[k] for k in picked]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Primal L2 machine with squared hinge loss by Newton steps on the active rows; the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    reg = np.eye(a.shape[1])
    reg[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        s = a[active]
        k = weight[active]
        w = np.linalg.solve(reg + 2 * c * (s * k[:, None]).T @ s, 2 * c * s.T @ (k * y[active]))
        now = y * (a @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class ToxicityModel:
    table: np.ndarray  # by subsequence code
    bias: float
    weights: tuple[float, ...]
    landmarks: list[str]

    def unit_scores(self, units: list[str]) -> np.ndarray:
        return table_scores(units, self.table) + self.bias

    def probability(self, top: tuple[float, float]) -> float:
        z = self.weights[0] * top[0] + self.weights[1] * top[1] + self.weights[2]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def two_best(scores: np.ndarray) -> tuple[float, float]:
    """The two largest, -1.5 for what is missing; beyond 3 either way nothing changes."""
    if len(scores) < 2:
        return (min(3.0, max(-1.5, float(scores[0]))) if len(scores) else -1.5), -1.5
    top = np.partition(scores, len(scores) - 2)[-2:]
    return min(3.0, max(-1.5, float(top[1]))), min(3.0, max(-1.5, float(top[0])))


def _bits(unit: str) -> set[str]:
    u = f"\0{unit}\0"
    return {u[k : k + 5] for k in range(max(1, len(u) - 4))} | {u[:k] for k in range(6, min(len(u), 12) + 1)}


def _gram_odds(units: list[str], whole: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Each unit's largest log odds of its grams: how much more often toxic texts have one than others do, from two
    deviations below the toxic and above the other count. Grams are told apart by their CRC-32."""
    lengths, grams = np.zeros(len(units), np.int64), array("I")
    for k, u in enumerate(units):
        own = [zlib.crc32(g.encode("utf-8", "replace")) for g in _bits(u)]
        lengths[k] = len(own)
        grams.extend(own)
    distinct, of = np.unique(np.frombuffer(grams, np.uint32), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    counts = {y: np.zeros(len(distinct)) for y in (0, 1)}
    for y, texts in whole.items():
        for ids in texts:
            counts[y][np.unique(np.concatenate([of[edges[k] : edges[k + 1]] for k in ids]))] += 1
    low = np.maximum(counts[1] - 2 * np.sqrt(counts[1]), 0.01) / len(whole[1])
    high = (counts[0] + 2 * np.sqrt(counts[0]) + 2) / len(whole[0])
    return np.maximum.reduceat((np.log(low) - np.log(high))[of], edges[:-1])


def _disguised(unit: str) -> list[str]:
    """A unit with gaps and with an inserted character, to train on."""
    half = len(unit) // 2
    return [".".join(unit), f"{unit[:half]}-{unit[half:]}", f"{unit[:half]}x{unit[half:]}", f"{unit[:-1]}q{unit[-1:]}", f"{unit[:1]}*{unit[1:]}"]


def fit_rows(rows: list[tuple[str, int]], landmarks: int = 256, negatives: int = 12_000, rounds: int = 3, disguises: int = 60) -> ToxicityModel | None:
    """From (text, label) rows."""
    number: dict[str, int] = {}
    bags: dict[int, list[list[np.ndarray]]] = {0: [], 1: []}
    for t, y in rows:
        sentences = [set(_windows([bare(u) for u in units_of(x)])[0]) for x in _SENTENCE.split(t or "")]
        bag = [np.array(sorted(number.setdefault(u, len(number)) for u in x), np.int32) for x in sentences if x]
        if bag:
            bags[y].append(bag)
    if not bags[0] or not bags[1]:
        return None
    units = list(number)
    whole = {y: [np.unique(np.concatenate(bag)) for bag in v] for y, v in bags.items()}
    odds = _gram_odds(units, whole)
    times = {y: np.bincount(np.concatenate([s for bag in v for s in bag]), minlength=len(units)) for y, v in bags.items()}
    clean = Counter({units[k]: int(times[0][k]) for k in np.flatnonzero(times[0])})
    sure = {units[k]: int(times[1][k]) for k in np.flatnonzero((times[1] > 0) & (odds >= math.log(12.0)))}
    model = None
    for _ in range(rounds):  # the witnesses stay; a round adds the clean units that the last machine found most toxic
        witnesses = Counter(sure)
        for u in [u for u in witnesses if clean[u] > 2 * witnesses[u]]:
            del witnesses[u]
        for u, k in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))[:disguises]:
            for v in _disguised(u):
                if v not in clean:
                    witnesses[v] += max(1, k // 4)
        if not witnesses:
            return None
        hard = []
        if model is not None:
            names = list(clean)
            scored = np.concatenate([model.unit_scores(names[a : a + 20_000]) for a in range(0, len(names), 20_000)])
            hard = [names[k] for k in np.argsort(-scored, kind="stable")[: negatives // 2]]
        usual = [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: negatives // 4]]
        rest = sorted(clean, key=lambda u: hash_of(u))[: negatives // 4 if model is not None else negatives]
        bad = list(dict.fromkeys([*hard, *usual, *rest]))
        bad = [u for u in bad if u not in witnesses]
        good = [u for u, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))]
        marks = pick_landmarks([*good[: 4 * landmarks], *bad[: 2 * landmarks]], landmarks)
        inner = kernel(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh(inner)
        root = vector / np.sqrt(np.maximum(value, 1e-4)) @ vector.T
        x = kernel([*good, *bad], marks) @ root
        y = np.array([1.0] * len(good) + [-1.0] * len(bad))
        k = np.array([min(witnesses[u], 20.0) for u in good] + [min(clean[u], 20.0) for u in bad])
        k = np.where(y > 0, k / k[y > 0].sum(), k / k[y < 0].sum()) * 200
        w = svm(x, y, k)
        beta = root @ w[:-1]
        table = np.zeros(CODES)
        of_mark = beta / _norms(marks)
        for codes, owner, weight in _subsequences(marks):
            np.add.at(table, codes, weight * of_mark[owner])
        model = ToxicityModel(table, float(w[-1]), (1.0, 0.0, 0.0), marks)
    tops, labels = [], []
    scores = np.concatenate([model.unit_scores(units[a : a + 20_000]) for a in range(0, len(units), 20_000)])
    for y, v in whole.items():
        tops += [list(two_best(scores[ids])) for ids in v]
        labels += [y] * len(v)
    model.weights = tuple(float(v) for v in logistic(tops, labels, ridge=1e-4))
    return model


def hash_of(unit: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(unit.encode("utf-8", "replace"), 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, landmarks: int = 256, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel | None:
    """per_class: the bound of the labelled sample of each class."""
    return fit_rows(labelled_sample(docs, labels, label, per_class, text, doc_id), landmarks)


class _Known(dict):
    def __init__(self):
        self.fresh: list[str] = []
        self.scores = np.zeros(0)

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, _Known()

    def score(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """(probability, the most toxic unit) of each whole text."""
        if len(self.known) > MOST_WORDS:
            self.known = _Known()
        known = self.known
        seen = [np.fromiter(map(known.__getitem__, u), np.int32, len(u)) for u in map(units_of, texts)]
        for a in range(0, len(known.fresh), 20_000):
            part = [bare(u) for u in known.fresh[a : a + 20_000]]
            names = list(set(part))
            of = dict(zip(names, self.model.unit_scores(names).tolist(), strict=True))
            known.scores = np.concatenate([known.scores, [of[u] for u in part]])
        known.fresh = []
        names = None
        out = []
        for ids in seen:
            s = known.scores[ids]
            p = self.model.probability(two_best(s))
            if p >= 0.5 and names is None:
                names = list(known)
            out.append((p, names[ids[int(s.argmax())]] if p >= 0.5 and len(ids) else None))
        return out


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) and witness (the most toxic unit of a predicted text) of every row."""
    tool = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(tool.value) if tool.value else None

        def of(batch: pa.RecordBatch) -> dict:
            texts = batch.column("t").to_pylist()
            got = scorer.score(texts) if scorer else [(0.0, None)] * len(texts)
            return {"doc_id": batch.column("i"), "score": [p for p, _ in got], "predicted": [int(p >= 0.5) for p, _ in got], "witness": [w for _, w in got]}

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t")), make, f"doc_id {kind}, score double, predicted int, witness string")
