import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import dualtree, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, leaf int, code string, score double"


def table(spark, rows):
    """Rows (vec_id, vector, label) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 7, "y", 0.5) for r in rows], SCHEMA)


def whole(vec):
    """The vector as whole numbers; None if it takes no part."""
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [math.floor(256 * x) for x in np.asarray(vec, np.float32).astype(np.float64).tolist()]


def clusters(rng, n, dims, spread=0.05, labels=4):
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for k in range(n):
        c = rng.choice(centres)
        out.append((k, [x + rng.gauss(0, spread) for x in c], rng.choice(range(labels))))
    return out


ODD = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, 2), (904, [float("-inf")] * 16, None)]


def coded(rows):
    """Plain-Python statement of the codes' contract over (id, whole vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in rows) // 16)
    parts = [[(v + [0] * (16 * width - len(v)))[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in rows]
    books = [[parts[k][p] for k in range(min(64, len(rows)))] for p in range(16)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            own = {}
            for x in parts:
                own.setdefault(near(x[p], book)[1], []).append(x[p])
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    best = [[near(x[p], books[p]) for p in range(16)] for x in parts]
    total = {}
    for (_, _, label), b in zip(rows, best, strict=True):
        total[label] = total.get(label, 0) + sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), total[label], digest) for (i, _, label), b in zip(rows, best, strict=True)]


def codes_of(df):
    return sorted(map(repr, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def as_rows(rows):
    return sorted(f"Row(vec_id={i!r}, code={c!r}, error={e!r}, label_error={t!r}, codebooks_sha256={d!r})" for i, c, e, t, d in rows)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_nearest_is_a_full_search(width):
    rng = np.random.default_rng(width)
    for size in (2, 30, 100_000):
        entries = rng.integers(-size, size + 1, (40, width))
        entries[7] = entries[3]  # a tie goes to the lower index
        x = np.concatenate([rng.integers(-size, size + 1, (300, width)), entries[:10]])
        full = ((x[:, None] - entries) ** 2).sum(axis=2)
        index, far = vectorcodes.Codebook(entries).nearest(x)
        assert index.tolist() == full.argmin(axis=1).tolist()
        assert far.tolist() == full.min(axis=1).tolist()


def test_bounds_never_exceed_the_distance_and_grow_finer():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-500, 500, (50, 12)), rng.integers(-500, 500, (20, 12))
    exact, before = ((x[:, None] - c) ** 2).sum(axis=2), None
    for edges in vectorcodes.block_edges(12):
        (xm, xn), (cm, cn) = vectorcodes._summary(x, edges), vectorcodes._summary(c, edges)
        bound = ((xm[:, None] - cm) ** 2 + (xn[:, None] - cn) ** 2).sum(axis=2)
        assert (bound <= exact + 1e-6).all()
        assert before is None or (bound >= before - 1e-6).all()
        before = bound


def test_codes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = clusters(rng, 150, 32, spread=0.3) + ODD + [(None, [0.25] * 32, None), (3, [0.5] * 32, None), (200, [-1.0] * 20, 2), (201, [], 3)]
    rows += rows[:5]
    want = coded([(i, whole(v), label) for i, v, label in rows if whole(v) is not None])
    assert codes_of(vectorcodes.encode(table(spark, rows).repartition(5))) == as_rows(want)


def test_few_or_no_vectors(spark):
    few = [(k, [0.1 * k] * 16, 0) for k in range(3)]
    assert codes_of(vectorcodes.encode(table(spark, few))) == as_rows(coded([(i, whole(v), label) for i, v, label in few]))
    assert codes_of(vectorcodes.encode(table(spark, []))) == codes_of(vectorcodes.encode(table(spark, ODD))) == []
    empty = vectorcodes.encode(table(spark, [(1, [], 0), (2, [], 0)])).collect()
    assert [(r["code"], r["error"]) for r in empty] == [("00" * 16, 0)] * 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        vectorcodes.encode(table(spark, [(1, [1e30] * 16, 0)])).collect()


def mined(rows, every, positives=5, negatives=10):
    """Plain-Python statement of the miner's contract over (id, whole vector, label)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = sorted({(i, tuple(v), label) for i, v, label in rows if i % every == 0})
    out = []
    for a, av, label in anchors:
        near = sorted(((-dot(av, v), i) for i, v, other in rows if other == label and i != a))[:positives]
        for s, p in near:
            hard = sorted((-dot(av, v), i) for i, v, other in rows if other != label and -30 * s <= 100 * dot(av, v) <= -90 * s)
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def pairs_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread, dims", [(0.05, 8), (0.6, 12)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread, dims):
    for name, value in {"LEAST": 40, "BLOCK": 30, "SLICE": 7, "FEW": 3, "SMALL": 8, "AT_ONCE": 2}.items():
        monkeypatch.setattr(dualtree, name, value)  # several leaves, blocks and slices
    rng = random.Random(dims)
    rows = clusters(rng, 400, dims, spread)
    rows += [(1000 + k, [0.5] * dims, k % 2) for k in range(100)]  # a hot vector: ties everywhere
    rows += ODD + [(None, [0.5] * dims, 1), (500, [0.5] * dims, None), (501, [1.0] * (dims - 3), 2), (502, [], 1)]
    rows += [rows[20], rows[21], (40, [0.3] * dims, 3)]  # rows and an anchor's id again
    want = mined([(i, whole(v), label) for i, v, label in rows if whole(v) is not None and i is not None and label is not None], 20)
    assert want
    got = dualtree.mine(table(spark, rows).repartition(3), F.col("vec_id") % 20 == 0)
    assert pairs_of(got) == want


def test_node_pairs_are_pruned_and_bounds_hold():
    rng = np.random.default_rng(4)
    centres = np.eye(8) * 300
    x = np.concatenate([centres[k] + rng.normal(0, 5, (200, 8)) for k in range(8)]).astype(np.int64)
    label = np.zeros(len(x), np.int64)
    anchors, cands = dualtree.Forest(x[::10], label[::10], 8), dualtree.Forest(x, label, 32)
    n = len(anchors.x)
    i, j, top = dualtree.leaf_pairs(anchors, cands, True, np.full((n, 1), 40_000), np.full((n, 1), 1 << 40))
    leaves = sum(k is None for k in anchors.kids) * sum(k is None for k in cands.kids)
    assert 0 < len(i) < leaves / 3
    lo, hi = dualtree.interval(anchors, i, cands, j)
    for a, c, low, high in zip(i, j, lo, hi, strict=True):
        s = anchors.x[anchors.rows(a)] @ cands.x[cands.rows(c)].T
        assert low <= s.min() and s.max() <= high


def test_no_anchors_no_rows(spark):
    assert pairs_of(dualtree.mine(table(spark, []), F.col("vec_id") % 20 == 0)) == []
    assert pairs_of(dualtree.mine(table(spark, ODD), F.lit(True))) == []
    one = [(1, [1.0] * 16, 0), (2, [1.0] * 16, 1)]
    assert pairs_of(dualtree.mine(table(spark, one), F.col("vec_id") % 20 == 0)) == []
    assert pairs_of(dualtree.mine(table(spark, one), F.lit(True))) == []  # no positives
