"""Near-duplicate texts by SimHash and Golay-code fuzzy keys: Jaccard similarity of word shingles at or above a bound.

simhash_golay links fingerprints that are almost equal. Here the fingerprint only finds candidates, so it is made to
change little: SimHash of a text's set of distinct words, 92 bits, four segments of 23. Texts whose five-word shingles
are four fifths alike differ in some 6 % of these bits, so most segments differ in two bits or fewer and have a fuzzy
key in common (see simhash_golay). A join key is the fuzzy keys nearest to two segments, at every size of the corpus.

That first pass makes classes out of what is close, cheaply, and may miss pairs: rows of a key of up to FEW rows are
compared each with each, in crowded keys each row with the first LEADERS and the LEADERS before it.

What decides is the second pass, which looks at all pairs that can be similar enough. Two sets of n shingles or fewer
that are `least` alike share one of their first n - ceil(least n) + 1 shingles in any fixed order (prefix filter). The
order has shingles that are frequent in a sample last, so that a template or a common passage is in few prefixes. Rows of a
shingle meet in one task, shingles that the sample says are very frequent in several (a salt); cells of up to MANY rows
are compared each with each, larger and salted ones each with the first LEADERS. Of these pairs the minhashes rule out
what is clearly not similar; the others are verified with the exact shingle sets. In cells of up to CROWD rows without
a salt all pairs are looked at too, by a wider bound: most rows of a shingle that is frequent only because the corpus is
large are like no other row there, and a few pairs are verified like the rest. Texts with the same smallest partner are
a bunch, dealt into blocks where it has more than SET_BLOCK shingles; each pair of blocks with pairs between them is a
group, so that the set of a text in a cluster of copies travels about once. Within a group, pairs that verified links
connect already need no look.

The third pass takes the shingles of the crowded cells once more, where pairs would grow with the square of a template's
copies, with those rows that the wider bound does not rule out beside all others of their cell; of salted and still larger
cells, with all rows. There the texts' sets travel instead: crowded shingles with the same smallest text are a bunch, its texts are dealt
into parts of about SET_PART shingles, and each pair of parts is a group, whose overlaps are counted exactly, without
a look at minhashes, and which returns no more links than it joins classes. Classes are the components of what passed. The tests
have the measured recall.

Defined cases: texts equal but for A-Z and white space are one node from the start; texts without words (null, empty,
blank) are equal; texts with fewer words than a shingle have one shingle; rows with null ids take their text's class and
give none their id; of rows that share an id, keep_one() keeps one where it keeps the id, whichever Spark meets first;
ties cannot arise, as a class is named by its smallest id; an empty table gives an empty result. Columns of docs may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import IdSet, filter_batches, hashed, map_batches, ship, slices
from ._base import written as cut
from .components import connected_components
from .simhash_golay import Golay

SEGMENT, SEGMENTS = 23, 4
PAIRS = [(a, b) for a in range(SEGMENTS) for b in range(a + 1, SEGMENTS)]
#: Of the 92 bits, in the first pass alone, and of the 128 one-bit minhashes of the shingles, in both, how many may
#: differ: at a similarity of 0.8 some 6 and 13 do after scattered edits, with deviations of 2.4 and 3.4. An added passage
#: of new words changes more of the 92 bits (some 14) and no more of the minhashes.
FAR, MINHASH_FAR = 15, 30
#: Of the 128 minhashes, in crowded cells: at 0.8 more differ in 1 of 500 million pairs, 36 or fewer in 1 of 170 000 at 0.05.
CROWD_FAR = 36
FEW, LEADERS = 6, 2
#: Rows of a shingle compared each with each at once, and rows that are if few of them are close; texts whose shingles are counted, and how often one occurs there
#: to count as frequent; rows of a cell of a salted shingle; shingles of a block of sets, and of a part of the third pass. They bear on cost alone.
MANY, CROWD, SAMPLE, FREQUENT = 48, 8192, 20_000, 8
CELL, SET_BLOCK, SET_PART = 4096, 1 << 20, 1 << 17


def word_set_simhash(words: list[bytes]) -> tuple[int, int]:
    """64 and 28 bits, unsigned."""
    known = set(words)
    if not known:
        return 0, 0
    of, ones = xxhash.xxh3_128_digest, np.zeros(96, np.int64)
    known = list(known)
    for at in range(0, len(known), 1 << 14):
        raw = np.frombuffer(b"".join(map(of, known[at : at + (1 << 14)])), np.uint8).reshape(-1, 16)[:, :12]
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(known)
    bits[SEGMENT * SEGMENTS :] = False
    low, high = np.packbits(bits[:64], bitorder="little"), np.packbits(bits[64:], bitorder="little")
    return int(low.view("<u8")[0]), int(high.view("<u4")[0])


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint32)
    of = xxhash.xxh32_intdigest
    return np.unique(np.array([of(b" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))], np.uint32))


_MULTIPLIERS = (np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def one_bit_minhashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, unsigned: of each of 128 orders of the shingles, a bit of the first one."""
    first = np.full(128, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at : at + 4096, None] * _MULTIPLIERS[None, :]
        mixed ^= mixed >> np.uint32(15)
        first = np.minimum(first, (mixed * np.uint32(0x2C1B3C6D)).min(axis=0))
    bits = np.packbits(((first * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint8), bitorder="little")
    return int(bits[:8].view("<u8")[0]), int(bits[8:].view("<u8")[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct arrays."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def frequent_shingles(docs: DataFrame, width: int, text: str) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Shingles that SAMPLE distinct texts have FREQUENT times or more, sorted, with their counts; and how many rows a row
    of the sample stands for."""
    n = docs.count()
    part = docs.select(docs[text].alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(max(1, int((1 << 20) * min(1.0, SAMPLE / max(n, 1))))))

    def make():
        def of(batch: pa.RecordBatch) -> dict:
            sets = [shingle_hashes(_words(t), width) for t in batch.column("t").to_pylist()]
            s, k = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_counts=True)
            return {"s": s.astype(np.int64), "k": k}

        return of

    rows = map_batches(part, make, "s long, k long").groupBy("s").agg(F.sum("k").alias("k")).where(F.col("k") >= FREQUENT).toArrow()
    s, k = rows.column("s").to_numpy(), rows.column("k").to_numpy()
    order = np.argsort(s)
    return (s[order].astype(np.uint32), k[order].astype(np.uint64)), max(1.0, n / SAMPLE)


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles in the order of (frequency, hash), as many as any set that is `least` alike must have one of."""
    most = len(shingles) - int(np.ceil(least * len(shingles) - 1e-6)) + 1
    if most >= len(shingles):
        return shingles
    known, counts = frequent
    rank = shingles.astype(np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank |= np.where(known[at] == shingles, counts[at], 0).astype(np.uint64) << np.uint64(32)
    return shingles[np.argpartition(rank, most - 1)[:most]]


def sketches(docs: DataFrame, width: int, text: str, doc_id: str, least: float = 0.8, frequent: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint32), np.zeros(0, np.uint64))) -> DataFrame:
    """doc_id, body (hash of the words), low and high (word-set SimHash), m1 and m2 (minhashes), size (of the shingle set),
    prefix (the set's first shingles, 4 bytes each) of every row."""
    ship(docs.sparkSession)
    tool = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        known = tool.value

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"body": [], "low": [], "high": [], "m1": [], "m2": [], "size": [], "prefix": []}
            for t in batch.column("t").to_pylist():
                w = _words(t)
                low, high = word_set_simhash(w)
                shingles = shingle_hashes(w, width)
                m1, m2 = one_bit_minhashes(shingles)
                for c, x in zip(out, (xxhash.xxh3_64_intdigest(b" ".join(w)), low, high, m1, m2, len(shingles), prefix(shingles, known, least).tobytes()), strict=True):
                    out[c].append(x)
            return {"doc_id": batch.column("i"), "high": out["high"], "size": out["size"], "prefix": out["prefix"]} | {k: np.array(out[k], np.uint64).view(np.int64) for k in ("body", "low", "m1", "m2")}

        return of

    return map_batches(docs.select(docs[doc_id].cast("long").alias("i"), docs[text].alias("t")), make, "doc_id long, body long, low long, high long, m1 long, m2 long, size long, prefix binary")


def fuzzy_pairs(low: np.ndarray, high: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, whether both codes are the nearest) of every key of every fingerprint."""
    n, keys, nearest = len(low), [], []
    parts = [((low >> np.uint64(23 * s)) & np.uint64(0x7FFFFF)).astype(np.int64) for s in range(2)]
    parts.append((((low >> np.uint64(46)) | (high << np.uint64(18))) & np.uint64(0x7FFFFF)).astype(np.int64))
    parts.append(((high >> np.uint64(5)) & np.uint64(0x7FFFFF)).astype(np.int64))
    for p in parts:
        at, code = golay.fuzzy_keys(p)
        grid = np.full((n, 6), -1)
        first = np.concatenate([[True], at[1:] != at[:-1]]) if n else np.zeros(0, bool)
        start = np.flatnonzero(first)
        grid[at, np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))] = code
        keys.append(grid)
        nearest.append(grid == (golay.codeword(p) >> 11)[:, None])
    out_at, out_key, out_own = [], [], []
    for number, (a, b) in enumerate(PAIRS):
        both = (keys[a][:, :, None] << 12) | keys[b][:, None, :]
        ok = (keys[a][:, :, None] >= 0) & (keys[b][:, None, :] >= 0)
        at = np.nonzero(ok)[0]
        out_at.append(at)
        out_own.append((nearest[a][:, :, None] & nearest[b][:, None, :])[ok])
        out_key.append((number << 24) | both[ok])
    return np.concatenate(out_at), np.concatenate(out_key), np.concatenate(out_own)


def compare(key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller place first) among rows sorted by key and node, where FAR bits or fewer differ."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [n]]))
    place, crowd = np.arange(n) - np.repeat(start, size), np.repeat(size > FEW, size)
    u, v = [node[:0]], [node[:0]]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(low[a] ^ low[b]).astype(int) + np.bitwise_count(high[a] ^ high[b]) <= FAR
        u.append(node[a[near]])
        v.append(node[b[near]])

    for rows, most in ((np.flatnonzero(~crowd), FEW - 1), (np.flatnonzero(crowd), LEADERS)):
        for back in range(1, most + 1):
            rows = rows[place[rows] >= back]
            keep(rows - back, rows)
    rows = np.flatnonzero(crowd)
    for k in range(LEADERS):
        rows = rows[place[rows] - k > LEADERS]
        keep(rows - place[rows] + k, rows)
    return np.concatenate(u), np.concatenate(v)


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes: node, low, high. Distinct pairs u, v that share the codes nearest to two of their segments."""
    ship(nodes.sparkSession)

    def make():
        golay = Golay()

        def of(batch: pa.RecordBatch) -> dict:
            node, low, high = (batch.column(c).to_numpy() for c in ("node", "low", "high"))
            parts = []
            for k in range(0, len(node), 500):
                at, key, own = fuzzy_pairs(low[k : k + 500].view(np.uint64), high[k : k + 500].view(np.uint64), golay)
                parts.append((at[own] + k, key[own]))
            at, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"key": key, "node": node[at], "low": low[at], "high": high[at].astype(np.int32)}

        return of

    def pairs(key, node, low, high) -> tuple[np.ndarray, np.ndarray]:
        return compare(key, node, low.view(np.uint64), high.view(np.uint32))

    rows = map_batches(nodes.select("node", "low", "high"), make, "key long, node long, low long, high int")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(by_whole_keys(pairs), "u long, v long").distinct()


def by_whole_keys(pairs, names: tuple[str, ...] = ("u", "v")):
    """A function of batches sorted by their first column that hands columns to `pairs` and cuts between keys only."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            new = [c.to_numpy() for c in b.columns]
            if not len(new[0]):
                continue
            done = int(np.searchsorted(new[0], new[0][-1]))  # the last key may go on
            if held and (done or held[-1][0][-1] != new[0][0]):
                yield out(held + [[x[:done] for x in new]])
                held = []
            elif done:
                yield out([[x[:done] for x in new]])
            held.append([x[done:] for x in new])
        if held:
            yield out(held)
        pa.default_memory_pool().release_unused()

    def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        found = np.stack(pairs(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(found, axis=1)], names=list(names))

    return run


def compare_all(key: np.ndarray, node: np.ndarray, m1: np.ndarray, m2: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller node first) of different components among rows sorted by key and node that the minhashes do not
    rule out: each with each in keys of up to MANY rows, else each with the first LEADERS."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [n]]))
    place, crowd = np.arange(n) - np.repeat(start, size), np.repeat(size > MANY, size)
    u, v = [node[:0]], [node[:0]]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        other = component[a] != component[b]
        a, b = a[other], b[other]
        near = np.bitwise_count(m1[a] ^ m1[b]).astype(int) + np.bitwise_count(m2[a] ^ m2[b]) <= MINHASH_FAR
        u.append(np.minimum(node[a[near]], node[b[near]]))
        v.append(np.maximum(node[a[near]], node[b[near]]))

    rows = np.flatnonzero(~crowd)
    for back in range(1, MANY):
        rows = rows[place[rows] >= back]
        if not len(rows):
            break
        keep(rows - back, rows)
    rows = np.flatnonzero(crowd)
    for k in range(LEADERS):
        rows = rows[place[rows] > k]
        keep(rows - place[rows] + k, rows)
    return np.concatenate(u), np.concatenate(v)


def close_rows(m1: np.ndarray, m2: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a cell: the pairs (places) of different components where CROWD_FAR minhashes or fewer differ, none if
    they are more than LEADERS a row, and which rows have such a partner. Rows of the largest class meet only the others."""
    n, most = len(m1), LEADERS * len(m1)
    _, at, members = np.unique(component, return_inverse=True, return_counts=True)
    others, seen, few = np.flatnonzero(at != np.argmax(members)), np.zeros(n, bool), True
    pairs = np.zeros((2, 0), np.int64)
    step = max(1, (1 << 20) // n)
    for k in range(0, len(others), step):
        q = others[k : k + step]
        near = np.bitwise_count(m1[q, None] ^ m1) + np.bitwise_count(m2[q, None] ^ m2) <= CROWD_FAR
        near &= at[q, None] != at
        seen |= near.any(axis=0)
        seen[q] |= near.any(axis=1)
        if few:
            a, b = np.nonzero(near)
            pairs = np.concatenate([pairs, np.sort([q[a], b], axis=0)], axis=1)
            if pairs.shape[1] > most:  # a pair of two others comes twice
                pairs = np.unique(pairs, axis=1)
                few = pairs.shape[1] <= most
    pairs = np.unique(pairs, axis=1) if few else pairs[:, :0]
    return pairs[0], pairs[1], seen


def sharing(nodes: DataFrame, salts: dict[int, int]) -> DataFrame:
    """nodes: node, m1, m2, component, prefix. Rows u, v, key: pairs u <> v (key -1) that share a shingle of their
    prefixes, and rows u = v of crowded shingles `key`: each row of one that is salted, or has rows of several components
    and more than CROWD; of smaller ones with many close pairs each row that has one. salts: into how many cells a
    shingle's rows are dealt."""
    ship(nodes.sparkSession)
    hot = np.array(sorted(salts), np.uint32)
    cells = np.array([salts[k] for k in sorted(salts)], np.uint64)
    tool = nodes.sparkSession.sparkContext.broadcast((hot, cells))
    names = ["key", "node", "m1", "m2", "component"]

    def spread(batches) -> Iterator[pa.RecordBatch]:
        hot, cells = tool.value
        for batch in batches:
            for part in slices(batch, 1 << 18):  # becomes some tenfold
                sets = [np.frombuffer(x, np.uint32) for x in part.column("prefix").to_pylist()]
                times = [len(x) for x in sets]
                if sum(times):
                    key = np.concatenate(sets)
                    rows = [np.repeat(part.column(c).to_numpy(), times) for c in names[1:]]
                    salt = np.zeros(len(key), np.uint64)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                        salt = np.where(hot[at] == key, hashed(rows[0]) % cells[at] + np.uint64(1), salt)
                    full = (key.astype(np.uint64) << np.uint64(31)) | salt
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full.view(np.int64), *rows)], names=names)
        pa.default_memory_pool().release_unused()

    def pairs(key, node, m1, m2, component) -> tuple[np.ndarray, ...]:
        u, v = compare_all(key, node, m1.view(np.uint64), m2.view(np.uint64), component)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        salted = (key[start] & 0x7FFFFFFF) > 0
        mixed = (size > MANY) & ~salted & (np.minimum.reduceat(component, start) < np.maximum.reduceat(component, start))
        crowd, us, vs = np.repeat(salted | (mixed & (size > CROWD)), size), [u], [v]
        for k in np.flatnonzero(mixed & (size <= CROWD)):
            cell = slice(start[k], start[k] + size[k])
            a, b, close = close_rows(m1[cell].view(np.uint64), m2[cell].view(np.uint64), component[cell])
            if len(a):
                us.append(node[cell][a])
                vs.append(node[cell][b])
            else:
                crowd[cell] = close
        u, v = np.concatenate(us), np.concatenate(vs)
        return np.concatenate([u, node[crowd]]), np.concatenate([v, node[crowd]]), np.concatenate([np.full(len(u), -1), key[crowd] >> 31])

    rows = nodes.select("node", "m1", "m2", "component", "prefix").mapInArrow(spread, ", ".join(f"{c} long" for c in names))
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(by_whole_keys(pairs, ["u", "v", "key"]), "u long, v long, key long")


def shingle_sets(ids: DataFrame, docs: DataFrame, width: int, text: str, doc_id: str, repeated: bool) -> DataFrame:
    """i and s (sorted 32-bit hashes, 4 bytes each) of the texts of ids (i). Texts of other ids are passed over where they
    are read and none is shuffled, unless IdSet has no room. repeated: whether ids may have several rows."""
    wanted = IdSet.made(ids)
    tool = docs.sparkSession.sparkContext.broadcast(wanted)
    texts = docs.select(docs[doc_id].cast("long").alias("i"), docs[text].alias("t"))
    if wanted is None:
        texts = texts.join(ids, "i", "left_semi")

    def make():
        wanted = tool.value

        def of(batch: pa.RecordBatch) -> dict:
            part = batch.filter(pa.array(wanted.holds(batch.column("i")))) if wanted is not None else batch
            return {"i": part.column("i"), "s": [shingle_hashes(_words(t), width).tobytes() for t in part.column("t").to_pylist()]}

        return of

    sets = map_batches(texts, make, "i long, s binary")
    return cut(sets.distinct() if repeated else sets)


def similar_across(node: np.ndarray, component: np.ndarray, part: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links between nodes of different components whose sets are at least that similar, as few as make the same
    components as all such pairs. Of several parts, pairs within one are left out. A set's shingles scatter ones into an
    array of overlaps with all sets at once, so that the similarities are exact."""
    n, size = len(node), np.array([len(s) for s in sets], np.int64)
    _, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(n), size)[np.argsort(of, kind="stable")]
    first, begin = np.cumsum(times) - times, np.cumsum(size) - size
    across = part.min() != part.max()
    names, at, members = np.unique(component, return_inverse=True, return_counts=True)
    u, v, above = [], [], np.arange(len(names))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for q in np.flatnonzero(at != np.argmax(members)):  # pairs within the largest class are known
        terms = of[begin[q] : begin[q] + size[q]]
        terms = terms[times[terms] > 1]
        length = times[terms]
        places = np.repeat(first[terms] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.bincount(posting[places], minlength=n)
        near = np.flatnonzero(both)
        near = near[(at[near] != at[q]) & ((part[near] != part[q]) | (not across))]
        near = near[both[near] / (size[q] + size[near] - both[near]) >= least]
        for x in near[np.unique(at[near], return_index=True)[1]]:
            a, b = top(at[q]), top(at[x])
            if a != b:
                above[max(a, b)] = min(a, b)
                u.append(int(node[q]))
                v.append(int(node[x]))
    return u, v


def crossing(rows: DataFrame, docs: DataFrame, least: float, width: int, text: str, doc_id: str, repeated: bool) -> DataFrame:
    """rows: key, node, component, size. Links u, v of different components that share a key and whose texts' shingle
    sets are at least that similar: the same components as all such pairs. Keys with the same smallest node are a bunch, as the shingles of a
    template or of a passage mostly are; its texts are dealt into parts of about SET_PART shingles, and each pair of parts
    meets in a group of its own, to which the sets travel. Texts of a bunch's largest class have parts of their own, which
    meet the others' parts only: their sets travel once for each of these. No row is made for a pair but for those linked."""
    bunches = rows.groupBy("key").agg(F.min("node").alias("bunch"))
    met = cut(rows.join(bunches, "key").select("bunch", "node", "component", "size").distinct())
    parts = met.groupBy("bunch", "component").agg(F.sum("size").alias("size")).groupBy("bunch").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count("*").alias("classes"))
    of = lambda size: F.greatest(F.ceil(size / SET_PART), F.lit(1)).cast("int")
    parts = parts.where("classes > 1").select("bunch", "main", of(F.col("all") - F.col("most")).alias("others"), F.when(F.col("all") > SET_PART, of(F.col("most"))).otherwise(0).alias("own"))
    inside = (F.col("component") == F.col("main")) & (F.col("own") > 0)
    dealt = met.join(parts, "bunch").withColumn("part", F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)))
    dealt = cut(dealt.select(F.xxhash64("bunch", F.least("part", "other"), F.greatest("part", "other")).alias("group"), F.col("node").alias("i"), "component", "part"))
    sets = shingle_sets(dealt.select("i").distinct(), docs, width, text, doc_id, repeated)

    def check(rows: pa.Table) -> pa.Table:
        node, component, part = (rows.column(c).to_numpy() for c in ("i", "component", "part"))
        found = similar_across(node, component, part, [np.frombuffer(x, np.uint32) for x in rows.column("s").to_pylist()], least)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return dealt.join(sets.hint("merge"), "i").select("group", "i", "component", "part", "s").groupBy("group").applyInArrow(check, "u long, v long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose minhashes do not speak against them: narrow joins before texts are looked at."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("m1", "m2").alias(f"m_{c}"))
    rows = pairs.where("u <> v").join(side("u"), "u").join(side("v"), "v")
    far = F.bit_count(F.col("m_u.m1").bitwiseXOR(F.col("m_v.m1"))) + F.bit_count(F.col("m_u.m2").bitwiseXOR(F.col("m_v.m2")))
    return rows.where(far <= MINHASH_FAR).select("u", "v")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, width: int, text: str, doc_id: str, repeated: bool) -> DataFrame:
    """Links u, v among the pairs of ids whose texts' shingle sets are at least that similar: the same components as
    all such pairs. nodes: node, size. repeated: whether ids may have several rows."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("i")).distinct()
    sets = shingle_sets(ids, docs, width, text, doc_id, repeated)
    # close to components for groups of copies, and one shuffle: pairs of one such group meet once, others once a pair of groups
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hanging = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component"))
    sizes = nodes.join(hanging, "node").select("node", "component", "size")
    parts = sizes.groupBy("component").agg(F.ceil(F.sum("size") / SET_BLOCK).cast("int").alias("parts"))
    place = cut(sizes.join(parts, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).alias("part")))
    left = place.select(F.col("node").alias("u"), F.xxhash64("component", "part").alias("a"))
    right = place.select(F.col("node").alias("v"), F.xxhash64("component", "part").alias("b"))
    grouped = cut(pairs.join(left, "u").join(right, "v").select(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("group"), "u", "v"))
    needed = grouped.select(F.col("group").alias("of"), F.explode(F.array("u", "v")).alias("i")).distinct().join(sets.hint("merge"), "i")

    def check(rows: pa.Table, held: pa.Table) -> pa.Table:
        found, of = [[], []], {}
        for i, s in zip(held.column("i").to_pylist(), held.column("s").to_pylist(), strict=True):
            of.setdefault(i, []).append(np.frombuffer(s, np.uint32))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        for u, v in sorted(zip(rows.column("u").to_pylist(), rows.column("v").to_pylist(), strict=True)):
            a, b = top(u), top(v)
            if a != b and any(jaccard(x, y) >= least for x in of[u] for y in of[v]):
                above[max(a, b)] = min(a, b)
                found[0].append(u)
                found[1].append(v)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return grouped.groupBy("group").cogroup(needed.groupBy("of")).applyInArrow(check, "u long, v long")


def classes(docs: DataFrame, least: float = 0.8, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, body, component (smallest doc_id of the class) of every row."""
    frequent, share = frequent_shingles(docs, width, text)
    rows = cut(sketches(docs, width, text, doc_id, least, frequent))
    first = [F.first(c).alias(c) for c in ("low", "high", "m1", "m2", "size", "prefix")]
    nodes = cut(rows.groupBy("body").agg(F.min("doc_id").alias("node"), *first))
    known = nodes.where("node is not null")
    one = cut(known.groupBy("node").agg(*first[:5]))
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    merged = None

    def link(found: DataFrame) -> None:
        nonlocal merged
        found = cut(found)
        if not found.isEmpty():  # the classes so far are stars, which need no more rounds
            known = found if merged is None else found.unionByName(merged.select(F.col("node").alias("u"), F.col("component").alias("v")))
            merged = cut(connected_components(known))

    def verify(pairs: DataFrame) -> None:
        pairs = cut(pairs)
        if not pairs.isEmpty():
            link(verified(pairs, one, docs, least, width, text, doc_id, repeated))

    def named(some: DataFrame) -> DataFrame:
        if merged is None:
            return some.withColumn("component", F.col("node"))
        return some.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))

    verify(likely(candidates(one), one))
    salts = {int(s): int(np.ceil(k * share / CELL)) for s, k in zip(*frequent, strict=True) if k * share > CELL}
    pairs = cut(sharing(named(known), salts))
    verify(pairs.where("u <> v").select("u", "v").distinct())
    crowded = pairs.where("u = v").select(F.col("u").alias("node"), "key")
    if not crowded.isEmpty():
        link(crossing(cut(named(crowded.join(known.select("node", "size"), "node"))), docs, least, width, text, doc_id, repeated))
    ids = named(nodes).select("body", F.col("component").alias("_c"))
    return rows.join(ids, "body").select("doc_id", "body", F.col("_c").alias("component"))


def keep_one(docs: DataFrame, least: float = 0.8, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, one of each class: its smallest id's. Rows with a null id stay. Of several rows
    with the kept id, one stays. Rows that stay for sure pass where they are read; only the others meet the ids."""
    rows = cut(classes(docs, least, width, text, doc_id).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component").alias("component")).where("doc_id is not null"))
    kept = rows.where("component = doc_id").select("doc_id")
    gone = IdSet.made(rows.where("component <> doc_id or rows > 1").select("doc_id"))
    if gone is None:
        clear, rest = docs.where(docs[doc_id].isNull()), docs
    else:
        tool = docs.sparkSession.sparkContext.broadcast(gone)
        ids = lambda batch: batch.column(doc_id).cast(pa.int64())
        clear = filter_batches(docs, lambda: lambda batch: ~tool.value.holds(ids(batch)))
        rest = filter_batches(docs, lambda: lambda batch: tool.value.holds(ids(batch)))
    rest = rest.join(kept, rest[doc_id] == kept["doc_id"], "left_semi")
    if not rows.where("rows > 1").isEmpty():
        rest = rest.dropDuplicates([doc_id])
    return clear.unionByName(rest)
