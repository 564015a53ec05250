"""Classifiers and sketches against plain dense versions, on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import op2_quality as op2
from gridloom.llm import op3_sketch as op3
from gridloom.llm import op4_language as op4
from gridloom.llm.common import gather
from gridloom.llm.linear import fit_hinge
from tests.llm.test_llm_operators import DATA, SCHEMA, lowered, odd_rows, plain_groups, shingles

xxhash = pytest.importorskip("xxhash")


def slow_hinge(x, y, cost):
    """Weights that minimise |w|^2 / 2 + cost * hinge loss, by projected gradient steps on the whole dual."""
    k = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(200_000):
        new = np.clip(alpha + step * (1 - k @ alpha), 0, cost)
        if np.abs(new - alpha).max() < 1e-10:
            break
        alpha = new
    return x.T @ (alpha * y)


@pytest.mark.parametrize("seed", range(3))
def test_hinge(seed):
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(25)]
    y, scale = np.where(rng.random(25) < 0.4, 1, -1), rng.normal(size=30)
    dense = np.zeros((25, 31))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / np.linalg.norm(scale[r])
    dense[:, 30] = 1
    want = slow_hinge(dense, y, 0.7)
    weights, bias = fit_hinge(rows, y, scale, 0.7, 3000, unit=True)
    assert np.allclose(dense @ np.append(weights, bias), dense @ want, atol=0.02)


def test_quality_model():
    """Log-count ratios, unit vectors and margins from dictionaries and dense arrays."""
    rng = random.Random(5)
    good = [" ".join(rng.choice("the cat sat on a mat and ran".split()) for _ in range(12)) for _ in range(14)]
    bad = [" ".join(rng.choice("buy now win cash free !!".split()) for _ in range(12)) for _ in range(11)]
    rows, y = list(op2.features(good + bad)), np.array([True] * 14 + [False] * 11)
    model = op2.QualityModel(rows, y)
    seen = {True: Counter(), False: Counter()}
    for r, label in zip(rows, y):
        seen[bool(label)].update(r.tolist())
    names = sorted({x for r in rows for x in r.tolist()})
    ratio = {x: np.log((seen[True][x] + 1) / 15) - np.log((seen[False][x] + 1) / 12) for x in names}
    dense = np.zeros((25, len(names) + 1))
    for i, r in enumerate(rows):
        v = np.array([ratio[x] for x in r.tolist()])
        dense[i, [names.index(x) for x in r.tolist()]] = v / np.sqrt(v @ v)
    dense[:, -1] = 1
    want = dense @ slow_hinge(dense, np.where(y, 1, -1), 1.0)
    got = np.array([model.margin(r) for r in rows])
    assert np.allclose(got, want, atol=0.05)
    a, b = model.sigmoid
    assert np.allclose([model.score(r) for r in rows], 1 / (1 + np.exp(-(a * got + b))))


def test_decoding():
    """Loss-weighted decoding by a loop over codewords and bits; the margin to the second; texts far from all."""
    rng = random.Random(3)
    words = {k: [f"{a}{b}{c}" for a in k for b in k for c in k] for k in ("abc", "def", "ghi", "jkl", "mno", "pqr")}
    texts = [(k, " ".join(rng.choice(w) for _ in range(30))) for k, w in words.items() for _ in range(20)]
    rows = list(op4.features([t for _, t in texts]))
    model = op4.LanguageModel(rows, [k for k, _ in texts])
    right = 0
    for (name, _), row in zip(texts, rows):
        values = [float(sum(float(model.weights[i, k]) for i in row.tolist())) / len(row) ** 0.5 + model.bias[k] for k in range(model.code.shape[1])]
        losses = [sum(model.trust[i, k] * np.log(1 + np.exp(-2.0 * int(model.code[i, k]) * values[k])) for k in range(len(values))) for i in range(len(model.names))]
        found, score, lead = model.decode(row)
        order = sorted(range(len(losses)), key=lambda i: losses[i])
        assert found == model.names[order[0]] and abs(lead - (losses[order[1]] - losses[order[0]])) < 1e-4
        assert abs(score - 1 / sum(np.exp(-4 * (x - losses[order[0]])) for x in losses)) < 1e-3
        assert model.knows(row)
        right += found == name
    assert right == len(texts)
    assert all(abs(x - 1) < 1e-9 for x in model.trust.sum(axis=1))
    # bits that contradict every codeword: outputs are turned against the nearest one
    row = rows[0]
    assert len(row) >= op4.LEAST_GRAMS and model.knows(row)
    model.weights, model.bias = np.zeros_like(model.weights), -0.2 * model.code.sum(axis=0)
    assert model.knows(row) == (model.losses(row).min() <= np.log(2)) and model.knows(row[:10])


def test_letters():
    """Numbers in other scripts and forms aren't letters."""
    assert not any(op4.has_letter(x) for x in ("½ ² Ⅷ ①", "123", "٣", "_", "—", "😀")) and all(op4.has_letter(x) for x in ("x", "ß", "漢", "1a", "ʰ"))


def plain_sketch(text, scale=op3.SCALE):
    """Digest, number of shingles and kept hashes, from the hash function itself."""
    long_ = lambda v, seed: xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    signed = lambda v: v - 2**64 if v >> 63 else v

    def chain(values):
        seed = 42
        for v in values:
            seed = long_(v, seed)
        return signed(seed)

    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    runs = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [chain(h)] if h else []
    return chain(h), len(runs), sorted({x for x in runs if x < -(2**63) + 2**64 // scale})


def plain_likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    both = len(set(a[2]) & set(b[2]))
    return both / (len(a[2]) + len(b[2]) - both) if both else 0.0


@pytest.mark.parametrize("ranges", [2, 7])
def test_sketches_plainly(spark, ranges):
    """All columns; odd rows with nulls, repeated ids and long texts; ids and texts in an order that ranges cut through."""
    rng = random.Random(1)
    words = "the a of cat dog ran sat on mat hill blue red".split()
    rows = [r for r in odd_rows() if not r[1] or len(r[1]) < 100_000] + [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "", "", 0) for i in (*range(100, 140), *[None] * 30, *[77] * 20)]
    signed = lambda v: v - 2**64 if v >> 63 else v
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    want = Counter()
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        s, e, n = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        inside = 1.0 if s[:2] == e[:2] else len(set(s[2]) & set(e[2])) / len(s[2]) if s[2] else None
        hexes = "".join(f"{x % 2**64:016x}" for x in s[2])
        want[(i, len(text), f"{s[0] % 2**64:016x}:{s[1]}:{hexes}", plain_likeness(s, e), plain_likeness(s, n), inside)] += 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit("clash") for n in ("key", "tie", "own", "next", "range", "at", "guest")})
    got = Counter((r.doc_id, r.n_chars, r.fingerprint, r.near_edited, r.near_next, r.contained_edited) for r in op3.fingerprint(docs, ranges=ranges).collect())
    assert got == want


def test_merged_sketches(spark):
    a, b = "one two three four five six seven eight nine ten", "four five six seven eight nine ten eleven twelve"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(op3.merged(op3.sketch(F.col("a"), scale=2), op3.sketch(F.col("b"), scale=2)).alias("m")).head()
    assert set(row.m) == set(plain_sketch(a, 2)[2]) | set(plain_sketch(b, 2)[2])


def test_gather(spark):
    """Bounds hold, repeated rows count once, and partitions don't matter."""
    rows = spark.createDataFrame([(i % 50, "x" * (i % 50)) for i in range(500)], "k int, v string")
    assert len(gather(rows, "v", 1000, 10**6)) == 50
    some = gather(rows, "v", 10, 10**6)
    assert len(some) == 10 and some == gather(rows.repartition(7), "v", 10, 10**6)
    assert sum(len(r.v) for r in gather(rows, "v", 1000, 200)) <= 200
    assert gather(rows.limit(0), "v", 5, 5) == []


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).withColumns({n: F.lit(n) for n in ("kept", "digest", "dropped", "kept_id", "label")})
    return docs, {name: stage(spark, docs, DATA) for name, stage in corpus_pipeline.STAGES}


def test_stages_on_odd_rows(spark, kept):
    """Each stage on nulls, empty and very long texts, ties, repeated rows and ids, and columns with names of its own."""
    docs, got = kept
    assert all(df.columns == docs.columns for name, df in got.items() if name != "packing")
    rows = [(i, t) for i, t, *_ in odd_rows()]
    of = lambda name: Counter((r.doc_id, r.text) for r in got[name].collect())
    good = {t for t in {t for _, t in rows}}
    assert of("quality") <= Counter(rows) and {t for _, t in of("quality")} <= good
    model = op4.fit(docs.filter(f"not ({op4.HELD_OUT})"))
    assert of("language") == Counter((i, t) for i, t in rows if t and op4.has_letter(t) and model.knows(next(op4.features([t]))))
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    assert Counter((i, lowered(t)) for i, t in of("exact_dedup").elements()) == Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    component = {(i, n): c for i, n, c in plain_groups(rows)}
    assert of("near_dedup") == Counter((i, t) for i, t in rows if i is None or component[(i, len(shingles(t, lowered)))] == i)
    assert {r.doc_id for r in got["packing"].collect()} == {i for i, _ in rows}


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DATA)
        assert found.collect() == [] and (name == "packing" or found.columns == docs.columns)
