"""SimHash classes, exact search, packing, scoring, mixing, token store, pipeline."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import _base, _tokens, backoff_scores, components, exact_topk, mixing, packing, registry, similar_texts, simhash_golay, token_store
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"
BYTES, WORDS = _tokens.tokenizer_path("byte_bpe_50k.json"), _tokens.tokenizer_path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def plain_fingerprint(text, width=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    """fps: {id: fingerprint}."""
    parent = {i: i for i in fps}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("text", [None, "", " ", "A", "a B", "a b c", "É a B c é É", words(300, 1), "x " * 50])
def test_fingerprint(text):
    assert simhash_golay.fingerprint(text) == plain_fingerprint(text)


def test_golay_is_perfect_and_fuzzy_keys_meet():
    g = simhash_golay.Golay()
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 5000)
    assert max(int(x).bit_count() for x in v ^ g.codeword(v)) <= 3
    u = v.copy()
    for k in range(len(u)):
        for b in rng.choice(23, rng.integers(0, 3), replace=False):
            u[k] ^= 1 << int(b)
    at, key = g.fuzzy_keys(v)
    bt, other = g.fuzzy_keys(u)
    assert set(np.bincount(at)) <= {1, 6}
    mine = set(zip(at.tolist(), key.tolist(), strict=True))
    assert {k for k, c in zip(bt.tolist(), other.tolist(), strict=True) if (k, c) in mine} == set(range(5000))


def test_simhash_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_classes(fps)
    got = registry.op3_simhash(spark, SF).collect()
    assert len(got) == len(texts)
    assert all(int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("bucket", [2, 1000])
def test_links_by_pairs_and_by_centres_agree_with_brute_force(spark, bucket):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                x ^= 1 << b
            fps.add(x)
    ids = {k: x for k, x in enumerate(sorted(fps))}
    signed = [(x - (1 << 64) if x >> 63 else x, k) for k, x in ids.items()]
    linked = components.connected_components(simhash_golay.links(spark.createDataFrame(signed, "fp long, node long"), bucket))
    got = {r.node: r.component for r in linked.collect()}
    want = plain_classes(ids)
    assert {k: got.get(k, k) for k in ids} == want


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(50))


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(None, 3), (4, None)], [(5, 1), (5, 2)], [(2, 9), (1, 9), (9, 3), (3, 9)], "random"])
def test_components_equal_brute_force(spark, pairs):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] if pairs == "random" else pairs
    above = {}

    def top(a):
        while above.setdefault(a, a) != a:
            a = above[a]
        return a

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    rows = components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.component for r in rows} == {x: top(x) for x in list(above)} and len(rows) == len(above)


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = simhash_golay.near_duplicates(odd_docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(rows) == odd_docs.count() and of[1] == of[2] == of[3] == {1} and of[6] == of[7] == {6}
    kept = simhash_golay.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10, 11] and ids.count(None) == 2
    assert simhash_golay.near_duplicates(odd_docs.limit(0)).count() == 0 and simhash_golay.keep_one(odd_docs.limit(0)).count() == 0


def plain_similar(texts, least=0.8, width=5):
    """Classes of {id: text} by the shingles' Jaccard similarity; pairs that share a shingle are looked at."""
    sets, by = {}, {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else {()}
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(texts):
        for j in {j for s in sets[i] for j in by[s] if j < i}:
            if find(i) != find(j) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in texts}


def test_similar_texts_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_similar({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.component for r in similar_texts.classes(docs).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.01 * sum(want[i] != i for i in want)


def edited(text, rng, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "".join(rng.choice("klmnop") for _ in range(6))
    return " ".join(w)


def test_large_groups_of_near_copies_collapse_without_all_pairs(make_docs):
    rng = random.Random(6)
    base = words(300, 50)
    texts = [base, *(edited(base, rng, rng.randrange(0, 6)) for _ in range(250)), *(words(200, 100 + k) for k in range(40))]
    docs = make_docs(list(enumerate(texts)))
    got = {r.doc_id: r.component for r in similar_texts.classes(docs).collect()}
    want = plain_similar(dict(enumerate(texts)))
    assert len(set(want.values())) == 41 and got == want
    nodes = similar_texts.sketches(docs, 5, "text", "doc_id").select(F.col("doc_id").alias("node"), "low", "high")
    assert similar_texts.candidates(nodes).count() <= 251 * (1 + 12 * similar_texts.LEADERS + 2 * similar_texts.FEW)


@pytest.mark.parametrize("small", [False, True])
def test_links_do_not_depend_on_the_size_of_the_corpus(make_docs, monkeypatch, small):
    """small: as if the corpus were large: salted shingles, many blocks of rows and of sets, no room for bitmaps."""
    if small:
        for name, value in (("CELL", 32), ("SET_BLOCK", 3000), ("SET_PART", 2000)):
            monkeypatch.setattr(similar_texts, name, value)
        monkeypatch.setattr(_base.IdSet, "MOST", 0)
    rng = random.Random(8)
    base = words(398, 60)
    variants = [edited(base, rng, 20) for _ in range(120)]
    texts = variants + [edited(t, rng, 2) for t in variants] + [edited(base, rng, 3) for _ in range(80)]
    texts += [t for k in range(40) for text in [words(200, 300 + k)] for t in (text, edited(text, rng, 3))]
    rng.shuffle(texts)
    docs = make_docs([*enumerate(texts), (None, texts[5])])
    got = {(r.doc_id, r.component) for r in similar_texts.classes(docs).collect() if r.doc_id is not None}
    of = plain_similar(dict(enumerate(texts)))
    assert got == set(of.items())
    kept = sorted(r.doc_id for r in similar_texts.keep_one(docs).collect() if r.doc_id is not None)
    assert kept == sorted(set(of.values()))


def test_unlike_texts_with_a_common_shingle_are_no_crowd(spark, make_docs):
    """A shingle is in many texts because the corpus is large: only pairs that may be similar go on, no whole cell."""
    rng = random.Random(12)
    texts = [words(60, 5000 + k) for k in range(200)]
    texts += [edited(texts[k], rng, 2) for k in range(3)]
    nodes = similar_texts.sketches(make_docs(list(enumerate(texts))), 5, "text", "doc_id").select(F.col("doc_id").alias("node"), "m1", "m2", F.col("doc_id").alias("component"), F.lit(bytes(4)).alias("prefix"))
    got = {(r.u, r.v) for r in similar_texts.sharing(nodes, {}).collect()}
    assert {(k, 200 + k) for k in range(3)} <= got and len(got) <= 10 and all(u < v for u, v in got)
    assert {(r.u, r.v) for r in similar_texts.sharing(nodes, {0: 3}).where("u = v").collect()} == {(k, k) for k in range(203)}


def test_close_rows_of_a_cell():
    rng = np.random.default_rng(13)
    m = rng.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    m[300:] = m[0] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2)).astype(np.uint64))
    m[100] = m[101]
    lone, one = np.arange(400), np.where(np.arange(400) >= 300, 300, np.arange(400))
    bits = [int(x) << 64 | int(y) for x, y in m]
    near = {(i, j) for j in range(400) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= similar_texts.CROWD_FAR}
    close = lambda k: similar_texts.close_rows(m[:, 0].copy(), m[:, 1].copy(), k)
    a, b, seen = close(one)
    want = {(i, j) for i, j in near if one[i] != one[j]}
    assert len(want) > 100 and {*zip(a.tolist(), b.tolist(), strict=True)} == want and {*np.flatnonzero(seen)} == {x for p in want for x in p}
    a, b, seen = close(lone)
    assert not len(a) and not len(b) and {*np.flatnonzero(seen)} == {x for p in near for x in p}
    assert not close(np.zeros(400, np.int64))[2].any()


def test_sets_of_the_largest_class_travel_once(make_docs, monkeypatch):
    """Links between a large class and a few texts are found without dealing each text of the class to every part."""
    rng = random.Random(14)
    base = words(300, 70)
    texts = [base, *(edited(base, rng, 2) for _ in range(150))]
    docs = make_docs(list(enumerate(texts)))
    component = [0] * 140 + list(range(140, 151))
    sizes = [len(similar_texts.shingle_hashes(t.encode().split(), 5)) for t in texts]
    rows = docs.sparkSession.createDataFrame([(7, k, c, n) for k, (c, n) in enumerate(zip(component, sizes, strict=True))], "key long, node long, component long, size long")
    written, plain = [], similar_texts.cut
    monkeypatch.setattr(similar_texts, "SET_PART", 4000)
    monkeypatch.setattr(similar_texts, "cut", lambda df: written.append(plain(df)) or written[-1])
    links = similar_texts.crossing(rows, docs, 0.8, 5, "text", "doc_id", False).collect()
    dealt = next(df for df in written if "group" in df.columns)
    assert dealt.groupBy("i").count().where("i < 140").agg(F.max("count")).first()[0] == 1
    of = plain_similar(dict(enumerate(texts)))
    above = {}
    for r in links:
        above.setdefault(component[max(r.u, r.v)], set()).add(component[min(r.u, r.v)])
    assert set(of.values()) == {0} and all(k in above for k in range(140, 151))


def test_columns_with_any_names(spark):
    rows = [(k, words(60, k % 7), k) for k in range(20)]
    for name in ("_id", "u", "node", "component", "rows", "body"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} long")
        kept = similar_texts.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(7))


def test_near_copies_among_variants_of_one_template(make_docs):
    """Crowded keys whose members are mostly not similar, each with one near copy that is far off in order of id."""
    rng = random.Random(9)
    base = words(398, 60)
    variants = [edited(base, rng, 20) for _ in range(300)]
    texts = variants + [edited(t, rng, 2) for t in variants]
    rng.shuffle(texts)
    docs = make_docs(list(enumerate(texts)))
    got = {r.doc_id: r.component for r in similar_texts.classes(docs).collect()}
    assert got == plain_similar(dict(enumerate(texts)))


def test_near_copies_with_an_added_passage(make_docs):
    """New words in one place change more of the word set than scattered edits that leave as many shingles alike."""
    rng = random.Random(10)
    texts = []
    for k in range(200):
        w, at = words(rng.randrange(60, 300), 700 + k).split(), rng.choice((0, 30, 60))
        texts += [" ".join(w), " ".join(w[:at] + words(int(len(w) * rng.choice((0.1, 0.15, 0.18))), 1700 + k).split() + w[at:])]
    got = {r.doc_id: r.component for r in similar_texts.classes(make_docs(list(enumerate(texts)))).collect()}
    want = plain_similar(dict(enumerate(texts)))
    assert got == want and len(set(want.values())) < 300


@pytest.mark.parametrize("parts", [1, 2])
def test_links_across_classes_join_what_all_pairs_join(parts):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 20, 40)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 41)], rng.integers(0, 1 << 20, rng.integers(0, 6))])).astype(np.uint32) for _ in range(150)]
    sets += [rng.integers(0, 1 << 20, 5).astype(np.uint32) for _ in range(5)]
    node, component, part = np.arange(155) * 3, rng.integers(0, 60, 155), np.arange(155) % parts
    u, v = similar_texts.similar_across(node, component, part, sets, 0.8)
    pairs = [(a, b) for a in range(155) for b in range(a) if (parts == 1 or part[a] != part[b]) and similar_texts.jaccard(sets[a], sets[b]) >= 0.8]
    assert len(u) < 60 and {(max(a, b) // 3, min(a, b) // 3) for a, b in zip(u, v, strict=True)} <= set(pairs)

    def joined(links):
        name = component.copy()
        for a, b in links:
            name[name == name[a]] = name[b]
        return [int(np.flatnonzero(name == x)[0]) for x in name]

    assert joined((a // 3, b // 3) for a, b in zip(u, v, strict=True)) == joined(pairs)


def test_similar_texts_of_odd_rows(odd_docs):
    rows = similar_texts.classes(odd_docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component)
    assert len(rows) == odd_docs.count() and of[1] == of[2] == of[3] == {1} and of[6] == of[7] == {6}
    kept = similar_texts.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10, 11] and ids.count(None) == 2
    assert similar_texts.classes(odd_docs.limit(0)).count() == 0


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want = registry.queries()[name](spark, SF), oracle(name)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.project(", ".join(columns)).fetchall())


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(-2, 3) / 64 + 0.001 for _ in range(4)]) for k in range(0, 120)]
    bad = [(500, None), (520, [None, 1.0]), (540, [float("nan")] * 4), (560, [float("inf")] * 4), (None, [1.0] * 4), (580, []), (600, [1.0])]
    d = spark.createDataFrame(rows + bad + [rows[33]], "vec_id long, embedding array<float>")
    got = exact_topk.top_k(d, F.col("vec_id") % 20 == 0, k=20, block=40).collect()
    ints = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v in rows + [(580, []), (600, [1.0]), rows[33]]]
    want = []
    for i, v in ints:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j) for j, u in ints if j != i)
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:20], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert exact_topk.top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_components_and_clashing_columns(spark):
    """Every finite double has a result: longs beyond 32 bits, sums beyond 64, components beyond a long."""
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.choice((0, 9, 15, 17, 40, 300)) for _ in range(3)]) for k in range(60)] + [(61, [1e9, 1e9, 0.0]), (80, [1e9, 1e9, 1e9])]
    names = "vec_id long, embedding array<double>, v long, x long, block long, asks long, score long, rank long, query_id long"
    d = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in rows], names)
    longs = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ints = [(i, [longs(math.floor(64 * x)) if math.isfinite(64 * x) else longs(int(math.copysign(1 << 64, x))) for x in v]) for i, v in rows]
    want = []
    for i, v in ints:
        if i % 20 == 0:
            scored = sorted((-longs(sum(a * b for a, b in zip(v, u, strict=True))), j) for j, u in ints if j != i)
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:20], 1)]
    got = exact_topk.top_k(d, F.col("vec_id") % 20 == 0, block=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_encoding_equals_the_library(spark, path):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    texts += ["", None, "a  b\n\n c \t d", "it's 'LL don't I'VE 123 __ a_b <|endoftext|>x", "naïve × ª ² Ⅷ", "日本語  end", "é x", "\x1c\x85 y", "   ", "İ ẞ", "a\x00b"]
    texts += ["\n", "a\n b", "a\n\n b", "a\n\n\nb", "\n\nb", "a \n b", "a.\nB,\n\nC.", "a\n\n", "'tis don't. can't, 'S", "\x02a b", "ǰ J̌ ʼn, É. ÉTÉ,", "x\u2003y \u2003z\u00a0 q", "ΟΔΟΣ, x", "\r\n x\r\ny", "a\u200b \u200bb"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["a", "B", "É", " ", " ", "\n", "\t", ".", ",", "'s", "1", "\u0301", "日"]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    of = library(path)
    assert _tokens.Encoder(path).encode(texts) == [np.array(of(t), "<u4").tobytes() for t in texts]


def test_fullest_combination_is_the_fullest():
    rng = random.Random(9)
    for _ in range(60):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 60)
        sums = {0}
        for length, n in left.items():
            sums |= {s + k * length for s in sums for k in range(n + 1)}
        used = packing.fullest(left, room)
        assert sum(a * b for a, b in used) == max(s for s in sums if s <= room) and all(n <= left[a] for a, n in used)


def check_packing(rows, texts, capacity=2048):
    of, by, seqs = library(BYTES), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids, at = np.array([*of(text), 0], "<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op6_packing(spark, SF).collect()
    n = check_packing(rows, texts)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_odd_rows(odd_docs):
    p = packing.pack(odd_docs, BYTES, with_ids=True)
    rows = p.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(p).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)
    assert all(bytes(r.ids) == whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] for r in rows)
    assert packing.pack(odd_docs.limit(0), BYTES).count() == 0


def plain_backoff(rows, reference, order, alpha=0.4):
    of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = lambda texts: {k: sum(1 for w in texts for i in range(len(w) - len(k) + 1) if tuple(w[i : i + len(k)]) == k) for w2 in texts for n in range(1, order + 1) for i in range(len(w2) - n + 1) for k in [tuple(w2[i : i + n])]}
    corpus = [of(t) for t in (reference or rows)]
    total, out = count(corpus), []
    for t in rows:
        w = of(t)
        own = count([w]) if reference is None else {}
        c = lambda k: total.get(k, 0) - own.get(k, 0)  # noqa: B023, E731
        size, log = max(sum(map(len, corpus)) - (len(w) if reference is None else 0), 1), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                k = tuple(w[i - n + 1 : i + 1])
                if c(k) > 0:
                    log += math.log(factor * c(k) / (c(k[:-1]) if n > 1 else size))
                    break
                factor *= alpha
            else:
                log += math.log(factor / size)
        out.append((len(w), log))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_equal_brute_force(make_docs, order, monkeypatch):
    monkeypatch.setattr(backoff_scores, "BLOCK", 40)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(12)] + [None, "", "zz"]
    docs = make_docs(list(enumerate(texts)))
    for ref in (None, [t for t in texts[:5]]):
        got = sorted(backoff_scores.score(docs, None if ref is None else make_docs(list(enumerate(ref))), order=order).collect())
        want = plain_backoff(texts, ref, order)
        assert [r.n_words for r in got] == [n for n, _ in want]
        assert np.allclose([r.log_score for r in got], [s for _, s in want])


def test_backoff_of_odd_rows(odd_docs):
    r = backoff_scores.score(odd_docs).collect()
    assert len(r) == odd_docs.count() and all(math.isfinite(x.log_score) for x in r)
    assert backoff_scores.score(odd_docs.limit(0)).count() == 0


def test_sainte_lague_equals_the_sequential_method(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        shares = [rng.choice([0.0, 1.0, rng.random() * 10 ** rng.randrange(4)]) for _ in range(rng.randrange(1, 9))]
        house = rng.randrange(0, 60)
        seats = [0] * len(shares)
        for _ in range(house if sum(shares) else 0):
            k = max(range(len(shares)), key=lambda k: (shares[k] / (2 * seats[k] + 1), -k))  # noqa: B023
            seats[k] += 1
        rows += [(g, k, s, house) for k, s in enumerate(shares)]
        want |= {(g, k): n for k, n in enumerate(seats)}
    d = spark.createDataFrame(rows, "g long, k long, share double, house long")
    assert {(r.g, r.k): r.seats for r in mixing.apportion(d, ["g"], "k", "share", "house").collect()} == want


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing_of_every_document(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op8_mixing(spark, SF).collect()
    size, taken = {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        size[s], taken[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = plain_targets(size)
    assert len(rows) == len(docs) and all(r.source_size == size[docs[r.doc_id].source] and math.isclose(r.target, want[docs[r.doc_id].source]) for r in rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)
    assert sorted(rows) == sorted(registry.op8_mixing(spark, SF).collect())


def test_mixing_of_odd_rows_and_hot_sources(make_docs, odd_docs):
    r = mixing.mix(odd_docs).collect()
    assert len(r) == odd_docs.count() and all(x.taken <= 2 * x.size for x in r)
    assert mixing.mix(odd_docs.limit(0)).count() == 0 and mixing.draw(odd_docs.limit(0)).count() == 0
    assert set(mixing.draw(odd_docs).columns) == set(odd_docs.columns)
    rows = [(k, words(1 + k % 17, k), "en", "hot" if k % 3 else f"s{k % 9}") for k in range(900)]
    docs = make_docs(rows)
    got = mixing.mix(docs, shard_docs=20).collect()
    target, taken = {x.source: x.target for x in got}, {}
    for x in got:
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - t) <= 0.03 * t + 16 for s, t in target.items())
    drawn = mixing.draw(docs, shard_docs=20).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()
    assert all(abs(x.w - target[x.source]) <= 0.1 * target[x.source] + 40 for x in drawn)


def test_mixing_is_native(spark):
    plan = registry.op8_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_token_store_round_trip(spark, odd_docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write(odd_docs, path, WORDS)
    of = library(WORDS)
    rows = token_store.read(spark, path).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, [*of(r.text), 1]) for r in odd_docs.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert np.frombuffer(token_store.read_document(spark, path, 5), "<u4").tolist() == [*of("one two"), 1]
    assert token_store.read_document(spark, path, 12345) is None
    empty = str(tmp_path / "empty")
    token_store.write(odd_docs.limit(0), empty, WORDS)
    assert token_store.read(spark, empty).count() == 0


def test_segment_refuses_another_dictionary():
    raw = token_store.write_segment([], 2, token_store.dictionary_hash(b"a"))
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Segment(raw, b"b")
    with pytest.raises(ValueError, match="no.* token segment"):
        token_store.Segment(b"x" * 40, b"a")


def test_token_ids_of_every_document(spark):
    of, at = library(WORDS), 0
    rows = sorted(registry.op10_token_ids(spark, SF).collect())
    for r, d in zip(rows, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array([*of(d.text), 1], "<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == first.columns and docs.dtypes == first.dtypes
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert set(kept[names[1]]) <= set(kept[names[0]]) and set(kept[names[2]]) <= set(kept[names[1]])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q]
    assert len([i for i in good if i in set(kept[names[0]])]) > 0.95 * len(good)
    before = {r.doc_id: r.text for r in first.collect() if r.doc_id in set(kept[names[1]])}
    assert kept[names[2]] == sorted(set(plain_similar(before).values()))
    assert len(kept[names[2]]) == len(set(kept[names[2]]))
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.sum("length")).first()[0] > 0 and out.count() >= len(kept[names[3]])


def test_pipeline_of_nothing_and_of_odd_rows(spark, odd_docs, tmp_path):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, docs in enumerate((base, base.limit(0))):
        d = str(tmp_path / str(k))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        assert corpus_pipeline.run(spark, d).count() >= 0


def test_id_sets_hold_their_ids_and_few_others(spark):
    import pyarrow as pa

    from tessera.llm._base import IdSet

    ids = [0, 1, -1, 7, 1 << 62, -(1 << 63), *range(1000, 3000, 2)]
    s = IdSet.made(spark.createDataFrame([(i,) for i in ids] + [(7,)], "i long"))
    assert s.holds(pa.array(ids)).all() and not s.holds(pa.array([None], pa.int64())).any()
    assert IdSet.made(spark.range(IdSet.MOST + 1)) is None
    assert s.holds(pa.array(range(1001, 3001, 2))).sum() < 100 and IdSet.made(spark.range(0)).holds(pa.array([5])).sum() == 0
