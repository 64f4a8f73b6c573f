import random

import numpy as np
import pytest

from claimlens.llm import ngramjoin

from .conftest import WORDS, frame
from .test_neardup import brute, corpus


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def wanted(texts, n, percent):
    root, sizes = brute(texts, n, percent)
    return [(k, sizes[k], root[k]) for k in range(len(texts))]


@pytest.mark.parametrize("n, percent, light", [(4, 85, 64), (4, 85, 2), (3, 60, 2)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, light):
    # several parts and cells; with small buckets counted as large ones, too; n-grams are soon frequent
    for name, value in {"STAR": 10, "PART": 15, "LIGHT": light, "FREQUENT": 5}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    texts = corpus(3)
    assert result(ngramjoin.jaccard_components(frame(spark, texts).repartition(3), shingle=n, percent=percent)) == wanted(texts, n, percent)


def test_members_of_one_group_with_several_components(spark, monkeypatch):
    """Texts that share the whole prefix and the size, in chains, and no n-gram with any other group."""
    monkeypatch.setattr(ngramjoin, "STAR", 2)
    monkeypatch.setattr(ngramjoin, "LIGHT", 2)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(120)] = rng.choice(WORDS) + "x"
        texts.append(" ".join(t))
    assert result(ngramjoin.jaccard_components(frame(spark, texts))) == wanted(texts, 4, 85)


def test_passages_link_nothing_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 5)
    rng = random.Random(8)
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60))
    texts = []
    for k in range(80):
        own = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.choice([5, 60, 200])))
        texts.append(f"{own} {passage}")
    texts += [passage, passage + " end", texts[3] + " more"]
    assert result(ngramjoin.jaccard_components(frame(spark, texts))) == wanted(texts, 4, 85)


def test_odd_texts(spark, odd_texts, with_null_id):
    want = wanted(odd_texts, 4, 85)
    got = ngramjoin.jaccard_components(with_null_id(odd_texts)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 1, None)]
    assert result(ngramjoin.jaccard_components(frame(spark, []))) == []
    assert result(ngramjoin.jaccard_components(frame(spark, [None, ""]))) == [(0, 0, 0), (1, 0, 1)]


def test_repeated_ids_are_decided_row_by_row(spark, prose):
    docs = frame(spark, [*prose[:6], prose[0] + " and so on"])
    other = frame(spark, [prose[20], prose[21] + " it", prose[0]])  # ids 0 to 2 again, with texts of their own
    again = frame(spark, [prose[21]]).selectExpr("doc_id + 50 as doc_id", "text", "lang", "source", "n_chars", "sig", "block", "body")
    rows = result(ngramjoin.jaccard_components(docs.union(other).union(docs).union(again)))
    assert len(rows) == 7 + 3 + 7 + 1
    assert [r[2] for r in rows if r[0] in (6, 50)] == [0, 0, 1]


def test_the_order_puts_frequent_ngrams_last(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [f"{passage} own{k} words{k} of{k} text{k}" for k in range(90)]
    frequent = ngramjoin.frequent_tokens(frame(spark, texts).repartition(7), 4)
    s = ngramjoin.shingle_sets(np.frombuffer(passage.encode(), np.uint8), np.asarray([0, len(passage)]), 4)[0]
    assert frequent.tolist() == [h for h in s.tolist() if h < int(ngramjoin.REGION)]
    places = ngramjoin.ordered(np.sort(np.append(s, np.uint64(5))), frequent)
    assert places[0] == 2 and (places >> np.uint64(63)).sum() == len(frequent)


def test_prefix_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(500):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64)
        y = np.unique(np.append(rng.choice(x, len(x) // 2), rng.integers(0, 60, rng.integers(1, 20)))).astype(np.uint64)
        px, py = x[: ngramjoin.prefix_length(len(x), 70)], y[: ngramjoin.prefix_length(len(y), 70)]
        overlap = len(np.intersect1d(x, y))
        assert ngramjoin.most_common(px, len(x), py, len(y)) >= overlap
        if 100 * overlap >= 70 * (len(x) + len(y) - overlap):
            assert len(np.intersect1d(px, py))
