"""Quality rules with an n-gram perplexity band.

The language model is an interpolated modified Kneser-Ney model over the bytes of a text, one for each language, always
of the same order. A text is seen as START bytes and then its words, a space before, between and after them; each byte
of a word and its closing space are predicted from the order - 1 bytes before, which reach over a word's beginning into
the word before (over one word's beginning at most). So a text's probability is a sum over its words, of what lies
within them, and over its junctions (the end of one word, the beginning of the next): distinct words and junctions are
counted and scored once a batch or task.

Spark counts the n-grams of full order of every text: a task counts its distinct words and junctions first, then their
n-grams by those counts, and a groupBy adds up. Lower orders count distinct left neighbours and follow from these. The
table is bounded by the byte alphabet, not by the corpus. Models are two sorted arrays of 64-bit hashes a language
(n-grams with their log probability, contexts with their log back-off weight); the hash is one to one. Where the
languages have more than `max_entries` n-grams together, they are modelled and scored a group of languages after the
other; results are the same.

Bands: for each language the median m of the log perplexity of the documents that pass the base rules, and its spread s
(interquartile range / 1.349). A document is kept between m - lower * s * w and m + upper * s * w, where
w = max(1, sqrt(median bytes / own bytes)) widens the band for short texts, whose mean varies more.

Defined cases: null and empty texts have no words, fail the base rules and have perplexity null; a null language is the
language ""; rows with null ids and repeated rows are judged like others and repeat; a value on a band's edge is inside;
an empty table gives an empty result. Other columns of docs, whatever their names, have no bearing on the verdict.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._base import cut, drop_encoders, map_batches, shared_dir, ship, slices

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW, LONG = 8, 50_000
ORDER, MAX_ORDER = 4, 5
START = b"\n"
#: Spreads below and above the median.
LOWER, UPPER = 5.0, 6.0
#: Steps of log perplexity in 1, for the quantiles: a power of two, so that steps are exact.
STEPS = 1 << 14
#: Distinct words that a task holds before it passes on what it has counted or forgets its scores.
MOST_WORDS = 200_000


def _twice(ids: np.ndarray) -> np.ndarray:
    """Places of the windows of WINDOW numbers that are in ids twice or more. Exact: windows are compared as bytes, in
    long texts by ranks of pairs, pairs of pairs and so on, which need no object a window."""
    n = len(ids) - WINDOW + 1
    if n < LONG:
        packed, width = ids.astype(np.int32).tobytes(), 4 * WINDOW
        windows = [packed[at : at + width] for at in range(0, 4 * n, 4)]
        if len(set(windows)) == n:
            return np.zeros(0, np.int64)
        times = Counter(windows)
        return np.array([i for i, x in enumerate(windows) if times[x] > 1], np.int64)
    ranks, step = ids.astype(np.int64), 1
    while step < WINDOW:
        ranks = np.unique(ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:], return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.flatnonzero(np.bincount(ranks)[ranks] > 1)


def base_statistics(text: str | None, words: list[bytes] | None = None, ids: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text. ids: equal numbers for equal words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    if words is None:
        words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = 0
    if n >= WINDOW:
        if ids is None:
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        at = _twice(ids)
        if len(at):
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW, -1)
            repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def _width(order: int) -> int:
    """Bytes that a junction takes from either word."""
    return max(order - 2, 0)


def _windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of `order` bytes that lie within space + word + space: (index of the word, packed bytes)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1  # after the opening space
    packed = raw[1:].copy()
    for back in range(1, order):
        packed[back - 1 :] |= raw[: len(of) - back + 1] << (8 * back)
    ok = place >= order - 1
    return of[ok], packed[ok]


def _junction_grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of `order` bytes that begin before a word's opening space: (index of the junction, packed bytes).
    A code is the tail of what comes before and the head of the word, _width(order) bytes each."""
    w = _width(order)
    head = codes & ((1 << (8 * w)) - 1)
    whole = ((codes >> (8 * w)) << (8 * (w + 1))) | (32 << (8 * w)) | head
    at, grams, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ones(len(codes), bool)
    for k in range(1, w + 1):
        here = np.flatnonzero(open_)
        at.append(here)
        grams.append((whole[here] >> (8 * (w - k))) & ((1 << (8 * order)) - 1))
        open_ &= ((head >> (8 * (w - k))) & 0xFF) != 32
    return np.concatenate(at), np.concatenate(grams)


class _Words(dict):
    """Words to numbers. A new word gets the next one and waits in `fresh` until settle() has its tail and head, the
    last bytes of space + word and the first of word + space."""

    def __init__(self, order: int):
        self.order, self.fresh = order, []
        self.tail, self.head, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def settle(self, model: LanguageModel | None = None) -> None:
        w, new = _width(self.order), self.fresh
        if not new:
            return
        if w:
            edge = lambda parts: np.array([int.from_bytes(x, "big") for x in parts], np.int64)
            self.tail = np.concatenate([self.tail, edge([(START * w + b" " + x)[-w:] for x in new])])
            self.head = np.concatenate([self.head, edge([(x + b" " + START * w)[:w] for x in new])])
        else:
            self.tail = self.head = np.zeros(len(self), np.int64)
        if model:
            parts = []
            for a in range(0, len(new), 20_000):
                of, grams = _windows(new[a : a + 20_000], self.order)
                parts.append(np.bincount(of, model.logp_of(grams), len(new[a : a + 20_000])))
            self.scores = np.concatenate([self.scores, *parts])
        self.fresh = []

    def junctions(self, ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """A code for every word of settled numbers: what came before and how it begins. opens: where texts begin."""
        w = _width(self.order)
        tail = np.concatenate([[0], self.tail[ids[:-1]]]) if len(ids) else np.zeros(0, np.int64)
        tail[opens] = int.from_bytes(START * w, "big")
        return (tail << (8 * w)) | self.head[ids]


def count_ngrams(docs: DataFrame, order: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram (packed bytes), c: the n-grams of `order` bytes of every text."""

    def run(batches):
        held: dict[str, tuple[_Words, list, list]] = {}

        def flush():
            for key, (known, times, codes) in held.items():
                if not known:
                    continue
                of, grams = _windows(list(known), order)
                total = np.zeros(len(known), np.int64)
                for t in times:
                    total[: len(t)] += t
                at, over = _junction_grams(np.concatenate([c for c, _ in codes]), order)
                found, inverse = np.unique(np.concatenate([grams, over]), return_inverse=True)
                c = np.bincount(inverse, np.concatenate([total[of], np.concatenate([n for _, n in codes])[at]]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(c, pa.int64())], names=["lang", "gram", "c"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                by: dict[str, list[np.ndarray]] = {}
                for t, key in zip(part.column("t").to_pylist(), part.column("l").to_pylist(), strict=True):
                    words = t.encode("utf-8", "replace").split() if t else []
                    if words:
                        by.setdefault(key or "", []).append(held.setdefault(key or "", (_Words(order), [], []))[0].numbers(words))
                for key, ids in by.items():
                    known, times, codes = held[key]
                    known.settle()
                    every = np.concatenate(ids)
                    times.append(np.bincount(every, minlength=len(known)))
                    codes.append(np.unique(known.junctions(every, np.cumsum([0, *map(len, ids[:-1])])), return_counts=True))
                if sum(len(known) + sum(len(c) for c, _ in codes) for known, _, codes in held.values()) > MOST_WORDS:
                    yield from flush()
        yield from flush()

    ship(docs.sparkSession)
    each = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(run, "lang string, gram long, c long")
    return each.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _hash(packed: np.ndarray, n: int) -> np.ndarray:
    """A one-to-one mix of packed bytes and their number."""
    x = packed.astype(np.uint64) | np.uint64(n << 56)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class LanguageModel:
    """Of one language: sorted hashes of the n-grams with log probabilities, of the contexts with log back-off weights."""

    order: int
    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    def logp_of(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each n-gram of `order` bytes, given the others."""
        total, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for n in range(self.order, 0, -1):
            at = np.flatnonzero(open_)
            g = grams[at] & ((1 << (8 * n)) - 1)
            found, where = _find(self.keys, _hash(g, n))
            total[at[found]] += self.logp[where[found]]
            open_[at[found]] = False
            if n > 1 and not found.all():
                rest = at[~found]
                known, c = _find(self.contexts, _hash(g[~found] >> 8, n - 1))
                total[rest[known]] += self.backoff[c[known]]
        total[open_] += np.log(self.unseen)
        return total

    #: Probability of a byte that the language never shows, once all of an order-1 model's mass for new bytes is used.
    unseen: float = 1 / 257


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    return (sorted_[at] == wanted) if len(sorted_) else np.zeros(len(wanted), bool), at


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 1, 1.5 where a count of counts is missing."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.01), k - 0.01) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def kneser_ney(grams: np.ndarray, counts: np.ndarray, order: int) -> LanguageModel:
    """From packed n-grams of `order` bytes and their counts. An n-gram of a lower order counts its distinct left
    neighbours; it has one at least, as texts begin with START bytes."""
    sort = np.argsort(grams)
    levels = {order: (grams[sort], counts[sort].astype(np.float64))}
    for n in range(order - 1, 0, -1):
        g, c = np.unique(levels[n + 1][0] & ((1 << (8 * n)) - 1), return_counts=True)
        levels[n] = g, c.astype(np.float64)
    keys, logp, contexts, backoff = [], [], [], []
    below_g = below_p = None
    unseen = 1 / 257
    for n in range(1, order + 1):
        g, c = levels[n]
        d = np.concatenate([[0.0], discounts(c)])[np.minimum(c, 3).astype(int)]
        own, inverse = np.unique(g >> 8, return_inverse=True)
        total = np.bincount(inverse, c)
        gamma = np.bincount(inverse, d) / total
        if n == 1:
            p = (c - d) / total[inverse] + gamma[inverse] / 257
            unseen = float(gamma[0]) / 257
        else:
            _, at = _find(below_g, g & ((1 << (8 * (n - 1))) - 1))
            p = (c - d) / total[inverse] + gamma[inverse] * below_p[at]
            contexts.append(_hash(own, n - 1))
            backoff.append(np.log(np.maximum(gamma, 1e-12)))
        keys.append(_hash(g, n))
        logp.append(np.log(p))
        below_g, below_p = g, p
    out = []
    for k, v in ((keys, logp), (contexts, backoff)):
        k, v = (np.concatenate(x) if x else np.zeros(0) for x in (k, v))
        sort = np.argsort(k.astype(np.uint64))
        out += [k.astype(np.uint64)[sort], v[sort].astype(np.float32)]
    return LanguageModel(order, *out, unseen)


def fit(docs: DataFrame, order: int = ORDER, max_entries: int = 4_000_000, text: str = "text", lang: str = "lang") -> Iterator[dict[str, LanguageModel]]:
    """Models from the n-grams of every text of docs, in groups of languages that have max_entries n-grams of `order`
    bytes together (a larger language is a group of its own): what is on the driver and broadcast at once. The order
    is the same whatever the corpus."""
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be from 1 to {MAX_ORDER}")
    counts = cut(count_ngrams(docs, order, text, lang))
    groups, room = [], 0
    for r in sorted(counts.groupBy("lang").count().collect()):  # a row a language
        if not groups or r["count"] > room:
            groups.append([])
            room = max_entries
        groups[-1].append(r.lang)
        room -= r["count"]
    for group in groups:
        t = counts.where(F.col("lang").isin(group)).toArrow()
        langs = t.column("lang").dictionary_encode().combine_chunks()
        of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        g, c = t.column("gram").to_numpy(), t.column("c").to_numpy()
        yield {key: kneser_ney(g[of == k], c[of == k], order) for k, key in enumerate(names)}


class Scorer:
    """Scores batches of texts; keeps the numbers of words between batches, up to MOST_WORDS a language."""

    def __init__(self, models: dict[str, LanguageModel]):
        self.models, self.known = models, {}

    def score(self, texts: list[str | None], langs: list[str | None]) -> list[tuple]:
        """For each text the base statistics, log perplexity (None without words or without a model) and bytes scored."""
        if sum(map(len, self.known.values())) > MOST_WORDS:
            self.known = {}
        out, by = [], {}
        for at, (t, lang) in enumerate(zip(texts, langs, strict=True)):
            words = t.encode("utf-8", "replace").split() if t else []
            key = lang or ""
            model = self.models.get(key)
            ids = self.known.setdefault(key, _Words(model.order if model else 1)).numbers(words)
            out.append((base_statistics(t, words, ids), None, sum(map(len, words)) + len(words)))
            if len(ids) and model:
                by.setdefault(key, []).append((at, ids))
        for key, some in by.items():
            known, model = self.known[key], self.models[key]
            known.settle(model)
            every, sizes = np.concatenate([ids for _, ids in some]), np.array([len(ids) for _, ids in some])
            opens = np.cumsum(sizes) - sizes
            codes, inverse = np.unique(known.junctions(every, opens), return_inverse=True)
            of, grams = _junction_grams(codes, model.order)
            total = np.add.reduceat(known.scores[every] + np.bincount(of, model.logp_of(grams), len(codes))[inverse], opens)
            for (k, _), x in zip(some, total.tolist(), strict=True):
                out[k] = (out[k][0], -x / out[k][2], out[k][2])
        return out


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, n_bytes long"


def _columns(got: list[tuple]) -> dict[str, list]:
    """What Scorer.score() gave, by the names of STATISTICS."""
    rows = [(*base, p, size) for base, p, size in got]
    return {f.split()[0]: list(x) for f, x in zip(STATISTICS.split(", "), zip(*rows, strict=True) if rows else [()] * 7, strict=True)}


def _of_group(docs: DataFrame, models: dict[str, LanguageModel], lang: str) -> DataFrame:
    return docs.where(F.coalesce(docs[lang], F.lit("")).isin(sorted(models)))


def statistics(docs: DataFrame, models: dict[str, LanguageModel], text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang, the base statistics, log_perplexity and n_bytes of every row: one narrow pass."""
    tool = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        scorer = Scorer(tool.value)

        def of(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("i"), "lang": batch.column("l")} | _columns(scorer.score(batch.column("t").to_pylist(), batch.column("l").to_pylist()))

        return of

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(docs[doc_id].alias("i"), docs[text].alias("t"), docs[lang].alias("l")), make, f"doc_id {kind}, lang string, {STATISTICS}")


def _quantile(rows: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """l and q, for each l the smallest value that at least a share of its rows does not exceed. Counts of values are
    exact and travel pre-aggregated, so reruns agree; a language's distinct values meet in one task, so their number must
    not grow with the rows."""
    counts = rows.groupBy("l", value.alias("x")).count()
    upto, of = F.sum("count").over(Window.partitionBy("l").orderBy("x")), F.sum("count").over(Window.partitionBy("l"))
    ranked = counts.select("l", "x", upto.alias("upto"), of.alias("of"))
    return ranked.groupBy("l").agg(F.array(*(F.min(F.when(F.col("upto") >= F.lit(s) * F.col("of"), F.col("x"))) for s in shares)).alias("q"))


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> dict[str, tuple[float, float, float, float]]:
    """language -> (median, spread * lower, spread * upper, median bytes) over the rows that pass the base rules: a row
    a language reaches the driver. Quantiles are of log perplexities in steps of 1 / STEPS."""
    passed = scored.where("log_perplexity is not null").where(~_failed()).select(F.coalesce("lang", F.lit("")).alias("l"), "log_perplexity", "n_bytes")
    steps = {r.l: [x / STEPS for x in r.q] for r in _quantile(passed, F.round(F.col("log_perplexity") * STEPS).cast("long"), [0.25, 0.5, 0.75]).collect()}
    sizes = {r.l: float(r.q[0]) for r in _quantile(passed, F.col("n_bytes"), [0.5]).collect()}
    spread = {key: max((q[2] - q[0]) / 1.349, 0.005) for key, q in steps.items()}
    return {key: (q[1], lower * spread[key], upper * spread[key], sizes[key]) for key, q in steps.items()}


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _inside(found: dict[str, tuple[float, float, float, float]], of: str = "") -> Column:
    """Whether a row of statistics, columns under `of`, is within its language's band; true without a perplexity or a band."""
    if not found:
        return F.lit(True)
    wide = lambda b: F.greatest(F.lit(1.0), F.sqrt(F.lit(b) / F.greatest(F.col(f"{of}n_bytes"), F.lit(1))))
    case = None
    for key, (m, a, z, b) in sorted(found.items()):
        ok = F.col(f"{of}log_perplexity").between(F.lit(m) - F.lit(a) * wide(b), F.lit(m) + F.lit(z) * wide(b))
        case = (F if case is None else case).when(F.coalesce(F.col(f"{of}lang"), F.lit("")) == key, ok)
    return F.coalesce(case.otherwise(True), F.lit(True))


def judge(docs: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_entries: int = 4_000_000) -> DataFrame:
    """The statistics of every row with base_failed, perplexity and kept."""
    scored, seen = None, []
    for models in fit(docs, order, max_entries, text, lang):
        seen += models
        part = cut(statistics(_of_group(docs, models, lang), models, text, lang, doc_id))
        scored = part if scored is None else scored.unionByName(part)
    rest = statistics(docs.where(~F.coalesce(docs[lang], F.lit("")).isin(seen)) if seen else docs, {}, text, lang, doc_id)  # languages without a word
    scored = rest if scored is None else scored.unionByName(rest)
    return scored.withColumns({"base_failed": _failed(), "kept": ~_failed() & _inside(bands(scored, lower, upper)), "perplexity": F.exp("log_perplexity")})


def keep(docs: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, text: str = "text", lang: str = "lang", max_entries: int = 4_000_000) -> DataFrame:
    """The rows of docs, all columns, that pass the base rules and their language's band. Texts are scored once: the
    rows that pass the base rules are written to the shared folder with what the band needs, and filtered from there."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/scored-{uuid.uuid4().hex}"
    ship(spark)
    extra = StructType.fromDDL(f"lang string, {STATISTICS}")
    schema, written = StructType([StructField("row", docs.schema), StructField("scored", extra)]), []
    for number, models in enumerate(fit(docs, order, max_entries, text, lang)):
        tool = spark.sparkContext.broadcast(models)

        def run(batches: Iterable[pa.RecordBatch], tool=tool) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            drop_encoders()
            arrow, scorer = to_arrow_schema(schema), Scorer(tool.value)
            for batch in batches:
                for part in slices(batch):
                    langs = part.column(lang).to_pylist()
                    found = {"lang": langs} | _columns(scorer.score(part.column(text).to_pylist(), langs))
                    ok = pa.array([not base_failed(n, r) for n, r in zip(found["n_words"], found["n_repeat_words"], strict=True)], pa.bool_())
                    kept = part.filter(ok)
                    row = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow.field("row").type, strict=True)], fields=list(arrow.field("row").type))
                    own = arrow.field("scored").type
                    more = pa.StructArray.from_arrays([pa.array(found[f.name], f.type).filter(ok) for f in own], fields=list(own))
                    yield pa.RecordBatch.from_arrays([row, more], schema=arrow)

        _of_group(docs, models, lang).mapInArrow(run, schema).write.parquet(f"{path}/{number}")
        written.append(f"{path}/{number}")
    if not written:
        return docs.where(F.lit(False))
    scored = spark.read.schema(schema).parquet(*written)
    return scored.where(_inside(bands(scored.select("scored.*"), lower, upper), "scored.")).select("row.*")
