"""Perplexity rules, compression classifier, language identification, toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import compression_quality, language_centroids, perplexity_rules, registry, toxicity_kernel
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    marked = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a b c d e f g h a b c d e f g h", "x\nx\n x\n\ny\ny", "é ü # <b> |", words(200, 5) + " " + words(50, 5) + "\n" + words(200, 5), "w " * 30, words(60_000, 6) + " " + words(300, 6)])
def test_base_statistics(text):
    assert perplexity_rules.base_statistics(text) == plain_base(text)


def test_base_statistics_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.op1_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def plain_kneser_ney(texts: list[str], order: int):
    """p(byte | bytes before it) by the textbook formula, from dictionaries."""
    full = Counter()
    for t in texts:
        stream = b"\n" * (order - 2) + b" " + b" ".join(t.encode().split()) + b" "
        full.update(stream[k - order + 1 : k + 1] for k in range(order - 1, len(stream)))
    levels = {order: full}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts, sums, kinds = {}, {}, {}
    for n, c in levels.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / max(n1 + 2 * n2, 1)
        cuts[n] = [0.0, 0.5, 1.0, 1.5] if not (n1 and n2 and n3 and n4) else [0.0] + [min(max(k - (k + 1) * y * b / a, 0.01), k - 0.01) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        sums[n], kinds[n] = Counter(), {}
        for g, v in c.items():
            sums[n][g[:-1]] += v
            kinds[n].setdefault(g[:-1], Counter())[min(v, 3)] += 1

    def p(context: bytes, byte: int) -> float:
        n, below = len(context) + 1, 1 / 257
        if n > 1:
            below = p(context[1:], byte)
        if context not in kinds[n]:
            return below
        c = levels[n][context + bytes([byte])]
        gamma = sum(cuts[n][k] * many for k, many in kinds[n][context].items()) / sums[n][context]
        return (c - cuts[n][min(c, 3)]) / sums[n][context] + gamma * below

    return p


def plain_log_perplexity(p, text: str, order: int) -> float:
    stream = b"\n" * (order - 2) + b" " + b" ".join(text.encode().split()) + b" "
    first = order - 1
    return -sum(math.log(p(stream[k - order + 1 : k], stream[k])) for k in range(first, len(stream))) / (len(stream) - first)


def test_kneser_ney_is_a_distribution():
    p = plain_kneser_ney([words(400, k) for k in range(3)], 4)
    for context in (b"", b"a", b" a", b"ab ", b"qqq", b"\n\n "):
        assert math.isclose(sum(p(context, x) for x in range(257 - 1)) + p(context, 0), 1.0, abs_tol=1e-9)


@pytest.mark.parametrize("room", [4_000_000, 1])
def test_perplexity_and_bands_equal_brute_force(make_docs, room):
    """Every row, at every grouping of the languages: junctions, short words, a byte that only one text has, odd rows."""
    order, upper = 4, 3.0
    rows = [(k, words(60 + 7 * (k % 9), k), "en" if k % 3 else "xx") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, " \n", "zz"), (103, words(30, 3), None), (104, "a b " * 12, "en"), (105, "Ω " + words(40, 9).upper(), "en"), (106, "9 8 7 6 5 4 3 2 1 0 " * 3, "xx"), (None, words(50, 2), "en"), (3, words(67, 3), "xx"), (107, "short", "en")]
    rows += [(200 + k, words(25, 50 + k), None) for k in range(4)]
    docs = make_docs([(i, t, lang, "s", 0) for i, t, lang in rows])
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.lang or "", r.perplexity, r.kept, r.base_failed, r.n_words) for r in perplexity_rules.judge(docs, order, 4.0, upper, max_entries=room).collect()), key=lambda x: x[:2])
    by = {}
    for _, t, lang in rows:
        if t and t.split():
            by.setdefault(lang or "", []).append(t)
    models = {lang: plain_kneser_ney(ts, order) for lang, ts in by.items()}
    want = []
    for i, t, lang in rows:
        base = plain_base(t)
        x = plain_log_perplexity(models[lang or ""], t, order) if t and t.split() else None
        want.append((i if i is not None else -1, lang or "", x, base[0] < 20 or 100 * base[4] > 30 * base[0], len(" ".join(t.split()).encode()) + 1 if x is not None else 0, base[0]))
    q = lambda xs, f: sorted(xs)[max(0, math.ceil(f * len(xs)) - 1)]
    want.sort(key=lambda x: x[:2])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[4] == w[3] and g[5] == w[5] and (g[2] is None) == (w[2] is None)
        if w[2] is None:
            assert not g[3]
            continue
        assert math.isclose(math.log(g[2]), w[2], abs_tol=1e-5)
        of = [x for x in want if x[1] == w[1] and x[2] is not None and not x[3]]
        m, s = q([x[2] for x in of], 0.5), max((q([x[2] for x in of], 0.75) - q([x[2] for x in of], 0.25)) / 1.349, 0.005)
        wide = max(1.0, math.sqrt(q([x[4] for x in of], 0.5) / w[4]))
        assert g[3] == (not w[3] and m - 4.0 * s * wide - 1e-5 <= w[2] <= m + upper * s * wide + 1e-5)
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.lang or "") for r in perplexity_rules.keep(docs, order, 4.0, upper, max_entries=room).collect())
    assert kept == sorted(g[:2] for g in got if g[3]) and len(kept) < sum(not w[3] for w in want)


def test_bands_are_exact_however_rows_are_dealt(spark):
    rng = random.Random(5)
    values = [("en" if k % 4 else None, 100, 0, rng.gauss(2, 0.1), rng.randrange(50, 5000)) for k in range(9000)]
    rows = spark.createDataFrame(values, "lang string, n_words long, n_repeat_words long, log_perplexity double, n_bytes long")
    found = [perplexity_rules.bands(rows.repartition(n)) for n in (1, 13, 40)]
    assert found[0] == found[1] == found[2] and perplexity_rules.bands(rows.limit(0)) == {}
    for lang, (m, _, _, b) in found[0].items():
        mine = [v for v in values if (v[0] or "") == lang]
        middle = math.ceil(len(mine) / 2) - 1
        assert abs(m - sorted(v[3] for v in mine)[middle]) <= 1 / perplexity_rules.STEPS and b == sorted(v[4] for v in mine)[middle]


def test_bands_reject_what_reads_unlike_its_language(spark):
    """On the labelled documents that pass the base rules, bad ones go far more often than good ones."""
    r = perplexity_rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    gone = {x.quality: (x.n, x.gone) for x in r.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()}
    assert gone[0][1] / gone[0][0] > 0.1 and gone[1][1] / gone[1][0] < 0.01


def test_rules_reject_what_no_language_writes(make_docs):
    rng = random.Random(3)
    odd = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(200))
    rows = [(k, words(150, k), "en") for k in range(60)] + [(100, odd, "en"), (101, words(20, 7), "en")]
    got = {r.doc_id: r.kept for r in perplexity_rules.judge(make_docs(rows)).collect()}
    assert not got.pop(100) and all(got.values())


def test_odd_rows_everywhere(odd_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (8, 0, 1), (9, 1, 1), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    n, empty = odd_docs.count(), odd_docs.limit(0)
    assert perplexity_rules.judge(odd_docs).count() == n and perplexity_rules.judge(empty).count() == 0
    assert set(perplexity_rules.keep(odd_docs).columns) == set(odd_docs.columns) and perplexity_rules.keep(empty).count() == 0
    for lab in (labels, labels.limit(0)):
        c = compression_quality.fit(odd_docs, lab)
        r = compression_quality.score(odd_docs, c).collect()
        assert len(r) == n and all(0 <= x.score <= 1 for x in r) and (lab is labels) == (c is not None)
        assert compression_quality.keep(odd_docs, c, threshold=0.0).columns == odd_docs.columns
        t = toxicity_kernel.fit(odd_docs, lab)
        r = toxicity_kernel.score(odd_docs, t).collect()
        assert len(r) == n and all(0 <= x.score <= 1 for x in r)
    assert compression_quality.fit(empty, labels) is None and toxicity_kernel.fit(empty, labels) is None
    m = language_centroids.fit(odd_docs)
    r = {x.doc_id: x for x in language_centroids.identify(odd_docs, m).collect()}
    assert r[1].nearest == r[2].nearest == r[3].nearest == "und" and r[6].nearest == "en"
    assert language_centroids.fit(empty) is None and {x.nearest for x in language_centroids.identify(odd_docs, None).collect()} == {"und"}


def test_toxic_words_late_in_texts_without_spaces_are_learned():
    rng = random.Random(4)
    run = lambda n: "".join(rng.choice("abcdefghkl") for _ in range(n))
    toxic, clean = ([run(rng.randrange(60, 90)) + middle + run(20) for _ in range(150)] for middle in ("zworstvuq", ""))
    m = toxicity_kernel.fit_rows([(t, 1) for t in toxic[:120]] + [(t, 0) for t in clean[:120]])
    assert m is not None and m.unit_scores(toxic[120:]).mean() > m.unit_scores(clean[120:]).max()


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    r = registry.op2_language_id(spark, SF).collect()
    held = [x for x in r if x.held_out]
    assert len(r) == len(truth) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.97


def test_distance_rejects_another_language():
    rows = [(words(80, k), "en") for k in range(40)] + [(words(80, k).replace("a", "ü").replace("b", "ß"), "de") for k in range(40)]
    p = language_centroids.Predictor(language_centroids.fit_rows(rows))
    (lang, cos, rejected), (_, far, out), und = p.predict([words(80, 99), "zzyx qwvut " * 20, "123 !"])
    assert lang == "en" and not rejected and out and far < cos and und == ("und", 0.0, True)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    r = [x for x in registry.op9_quality_classifier(spark, SF).collect() if x.held_out and x.doc_id in labels]
    assert sum(x.predicted == labels[x.doc_id] for x in r) / len(r) > 0.9
    assert all(x.predicted == (x.score >= 0.7) for x in r)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    r = [x for x in registry.op4_toxicity(spark, sf).collect() if x.held_out and x.doc_id in labels]
    assert sum(x.predicted == labels[x.doc_id] for x in r) / len(r) > 0.93
    clean = [x for x in r if not labels[x.doc_id]]
    assert sum(x.predicted for x in clean) / len(clean) < 0.05


def test_kernel_equals_brute_force_and_tolerates_gaps():
    def features(u):
        s, out = "\0" + u + "\0", {}
        c = toxicity_kernel._classes(np.array([ord(x) for x in s], np.uint32))
        for steps in toxicity_kernel.PATTERNS:
            for k in range(len(s) - sum(steps)):
                at, code = k, int(c[k])
                for step in steps:
                    at += step
                    code = (code << 6) | int(c[at])
                if len(steps) == 3:
                    code = toxicity_kernel.TRIPLES + (((code * 2654435761) >> 7) & ((1 << 20) - 1))
                out[code] = out.get(code, 0) + toxicity_kernel.DECAY ** (sum(steps) + 1)
        return out

    units = ["idiot", "i.d.i.o.t", "hello", "aaaa", "é", "xx"]
    got = toxicity_kernel.kernel(units, units)
    for i, a in enumerate(map(features, units)):
        for j, b in enumerate(map(features, units)):
            dot = sum(v * b.get(k, 0) for k, v in a.items())
            size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert abs(got[i, j] - (dot / size if size else 0)) < 1e-4
    assert got[0, 1] > got[0, 2]


def test_gapped_and_inserted_insults_are_found():
    rng = random.Random(1)
    clean = [(". ".join(words(12, 1000 + k * 7 + j) for j in range(4)), 0) for k in range(150)]
    bad = [(f"{words(10, 5000 + k)} {rng.choice(['moron', 'idiot', 'stupid'])} {words(10, 9000 + k)}", 1) for k in range(60)]
    s = toxicity_kernel.Scorer(toxicity_kernel.fit_rows([*clean, *bad]))
    texts = [f"{words(10, 77)} {x} {words(10, 78)}" for x in ("idiot", "i.d.i.o.t", "idi-ot", "mo-ron", "i d i o t", "IDIOT!!")]
    assert all(p >= 0.5 for p, _ in s.score(texts))
    assert all(p < 0.5 for p, _ in s.score([words(60, 4000 + k) for k in range(30)]))
    assert s.score([""])[0][0] == s.score([None])[0][0] < 0.5
