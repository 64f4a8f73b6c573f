import random

import numpy as np
import pytest

from claimlens.llm import neardup
from claimlens.llm.components import connected_components

from .conftest import WORDS, frame


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(rng, words, rate):
    return [w if rng.random() > rate else rng.choice(WORDS) + "x" for w in words]


def corpus(seed=1):
    """Chains of edits, copies, and a large group in which some pairs are near enough and some are not."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 150))]
        for _ in range(6):
            texts.append(" ".join(base))
            base = edited(rng, base, 0.03)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(140)]
    texts += [" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.04, 0.08]))) for _ in range(120)]
    texts += [texts[0], texts[5].upper().replace(" ", "  \n"), "one two", "one  TWO", "a b c", "", None, " \t"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(neardup, "STAR", 25)  # several parts of the large group
    monkeypatch.setattr(neardup, "PART", 15)
    texts = corpus()
    want, sizes = brute(texts, n, percent)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, texts), shingle=n, percent=percent).collect()}
    assert [rows[k]["component_id"] for k in range(len(texts))] == want
    assert [rows[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert all(rows[k]["kept"] == (want[k] == k) for k in range(len(texts)))


@pytest.mark.parametrize("percent", [80, 85, 95, 100])
def test_pigeonhole_guarantee(percent):
    """Any two signatures within the bound share a key, however the errors lie."""
    m, bound = neardup.plan(percent)
    assert bound == 2 * m - 1
    rng = np.random.default_rng(1)
    lanes = m * neardup.WIDTH
    for k in range(400):
        a = rng.integers(0, 65536, lanes).astype(np.uint16)
        b = a.copy()
        far = bound if k % 2 else rng.integers(0, bound + 1)
        at = rng.choice(lanes, far, replace=False)
        if k % 4 == 1:  # two errors in every chunk but one
            at = [c * neardup.WIDTH + j for c in range(m) for j in (0, 3)][:bound]
        b[at] ^= 1
        keys = neardup.chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_all_pairs_within_the_bound_share_a_key():
    """Exhaustively, over the signatures of a corpus: what a bucket joins holds every pair at a distance up to the bound."""
    m, bound = neardup.plan(85)
    texts = [t for t in corpus(3) if t and t.split()]
    raw = [t.encode() for t in texts]
    sets = neardup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]), 3)
    sig = neardup.signatures(sets, m * neardup.WIDTH)
    keys = [set(k) for k in neardup.chunk_keys(sig)]
    near = [(i, j) for i in range(len(sig)) for j in range(i) if (sig[i] != sig[j]).sum() <= bound]
    assert len(near) > 500 and all(keys[i] & keys[j] for i, j in near)


def test_links_join_all_that_can_be():
    rng = random.Random(2)
    base = set(range(200))
    sets = [np.array(sorted((base - set(rng.sample(sorted(base), k))) | {1000 * i + j for j in range(k)}), np.uint64) for i, k in enumerate([0, 5, 8, 30, 33, 90])]
    links = neardup.link_sets(list(range(6)), sets, 85)
    root = {i: i for i in range(6)}
    for a, b in links:
        root = {k: (min(root[a], root[b]) if v in (root[a], root[b]) else v) for k, v in root.items()}
    joined = {(i, j) for i in range(6) for j in range(i) if root[i] == root[j]}
    direct = {(i, j) for i in range(6) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}
    assert direct <= joined and len(links) <= 5


def test_odd_rows(spark, odd_texts, with_null_id):
    df = with_null_id(odd_texts)
    rows = neardup.near_duplicates(df.union(df.filter("doc_id = 5"))).collect()
    assert len(rows) == len(odd_texts) + 2
    assert [r["component_id"] for r in rows if r["doc_id"] == 6] == [5]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 50), (60, 60), (1, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40, 50: 40}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_a_repeated_id_are_decided_one_by_one(spark):
    rng = random.Random(4)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(3)]
    text = [" ".join(b) for b in base]
    near = [t + " more" for t in text]
    rows = [(1, text[0]), (7, near[0]), (7, text[1]), (9, near[1]), (9, text[2]), (9, text[2]), (12, near[2]), (None, text[0]), (None, near[1])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, keyed=True)
    key = {r[1]: r[0] for r in spark.createDataFrame([(t,) for t in text + near], "text string").selectExpr("xxhash64(text)", "text").collect()}
    found = sorted(((r["doc_id"], r["text_key"], r["component_id"], r["kept"]) for r in got.collect() if r["doc_id"] is not None))
    assert found == sorted([(1, key[text[0]], 1, True), (7, key[near[0]], 1, False), (7, key[text[1]], 7, True), (9, key[near[1]], 7, False), *[(9, key[text[2]], 9, True)] * 2, (12, key[near[2]], 9, False)])
    assert sum(r["doc_id"] is None and r["kept"] for r in got.collect()) == 2
