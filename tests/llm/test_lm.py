import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import knlm, lmscore, queries
from claimlens.llm.common import remainder
from claimlens.llm.gru import N_SYMBOLS, Gru

from .conftest import frame


def test_gradient():
    rng = np.random.default_rng(0)
    g = Gru(rng.normal(0, 0.3, len(Gru().flat)))
    x, y = rng.integers(0, N_SYMBOLS + 1, (3, 5)), rng.integers(0, N_SYMBOLS, (3, 5))
    y[0, 4] = -1  # padding
    _, grad = g.gradient(x, y)
    for k in rng.choice(np.flatnonzero(np.abs(grad) > 2e-3), 10):
        keep = g.flat[k]
        g.flat[k] = keep + 1e-2
        up = g.gradient(x, y)[0]
        g.flat[k] = keep - 1e-2
        down = g.gradient(x, y)[0]
        g.flat[k] = keep
        assert grad[k] == pytest.approx((up - down) / 2e-2, abs=3e-4)


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(1)
    g = Gru(rng.normal(0, 0.3, len(Gru().flat)))
    texts = [rng.integers(0, N_SYMBOLS, n) for n in (200, 3, 1, 64, 65, 130)] + [np.zeros(0, np.int64)]
    for s, got in zip(texts, g.score(texts, together=4)):
        want = -g.gradient(np.concatenate([[N_SYMBOLS], s[:-1]])[None], s[None])[0] * len(s) if len(s) else 0.0
        assert got == pytest.approx(want, rel=1e-5)


def test_output_is_a_distribution():
    g = Gru(np.random.default_rng(2).normal(0, 0.5, len(Gru().flat)))
    h = np.random.default_rng(3).normal(0, 1, (1, 16)).astype(np.float32).repeat(N_SYMBOLS, axis=0)
    assert np.exp(g._log_probs(h, np.arange(N_SYMBOLS))).sum() == pytest.approx(1.0, rel=1e-5)


def test_training_learns_order():
    windows = [np.asarray([N_SYMBOLS, *([5, 9, 700, 33] * 6)]) for _ in range(64)]
    g = Gru()
    first = g.gradient(np.stack([w[:-1] for w in windows]), np.stack([w[1:] for w in windows]))[0]
    assert g.train(windows, epochs=150, batch=32) < 0.2 < first


def test_training_carries_the_state():
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, N_SYMBOLS, n), 0).astype(np.int16) for n in (90, 7, 0, 200, 64)]
    g, seen = Gru(), []
    whole = g.gradient

    def spy(x, y, state):
        seen.append((x.copy(), y.copy(), state.copy()))
        return whole(x, y, state)[0], np.zeros_like(g.flat)  # the parameters stay

    g.gradient = spy
    assert g.train_texts(texts, streams=2, steps=32) == sum(map(len, texts))
    y = np.concatenate([s[1] for s in seen], axis=1).reshape(-1)
    assert y[y >= 0].tolist() == np.concatenate(texts).tolist()
    x = np.concatenate([s[0] for s in seen], axis=1).reshape(-1)
    ends = np.cumsum([len(t) for t in texts])
    assert np.flatnonzero(x == N_SYMBOLS).tolist() == [0, *ends[:-1].tolist()]
    # the loss over all windows is that of the whole texts but for the one that the second row begins in
    state = np.zeros((1, 16), np.float32)
    losses = [g.__class__.gradient(g, s[0][:1], s[1][:1], state)[0] * (s[1][:1] >= 0).sum() for s in seen]
    row = np.concatenate([s[1][:1] for s in seen], axis=1)[0]
    parts = np.split(row, [k for k in ends.tolist() if k < len(row)])
    assert sum(losses) == pytest.approx(-g.score(parts).sum(), rel=1e-4)
    assert np.abs(seen[1][2]).max() > 0


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch, prose):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 6_000)
    docs = frame(spark, prose * 2)
    runs = []
    for n in (1, 3, 11):
        rows = lmscore.score_texts(docs.repartition(n, F.rand(n)), remainder(10) != 0).collect()
        runs.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in rows})
    assert len(runs[0]) == 2 * len(prose)
    for other in runs[1:]:
        assert all(other[k] == pytest.approx(v, rel=1e-6) for k, v in runs[0].items())


def test_hot_words_are_counted_like_all_others(spark):
    rng = np.random.default_rng(2)
    rows = [(b, f"w{k}".encode(), int(rng.integers(0, 40 if k < 9 else 2))) for b in range(12) for k in range(60) if k % 3 or b < 2]
    shares = spark.createDataFrame(rows, "block int, word binary, n long")
    want = Counter()
    for _, w, n in rows:
        want[w] += n
    total = sum(want.values())
    blocks = Counter(w for _, w, _ in rows)
    for part in (1e-9, 0.03, 2.0):  # all hot, some, none
        lmscore.HOT, before = part, lmscore.HOT
        got = sorted((r["block"], bytes(r["word"]), r["n"], r["c"], r["blocks"]) for r in lmscore._counted(shares, total).collect())
        lmscore.HOT = before
        assert got == sorted((b, w, n, want[w], blocks[w]) for b, w, n in rows)


def brute_base(texts):
    counts = Counter()
    for k, t in texts.items():
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            counts.update((t or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    total = math.log10(n + 0.1 * (v + 1))
    out = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split() + [None]
        out[k] = (len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10(counts[w] + 0.1) - total for w in words))
    return out


def test_base_and_score(spark, monkeypatch, odd_texts, prose, with_null_id):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 20_000)  # several blocks
    texts = odd_texts + prose
    rows = {r["doc_id"]: r for r in lmscore.score_texts(with_null_id(texts), remainder(10) != 0).collect()}
    for k, want in brute_base(dict(enumerate(texts)) | {None: "null id"}).items():
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9) and r["score"] < 0
    assert rows[5]["score"] == pytest.approx(rows[6]["score"], rel=1e-5)


def test_training_windows_hold_every_word_and_end():
    import pyarrow as pa

    texts = ["a b", "", " ".join("abcz"[k % 4] for k in range(700)), "b " * 31, "b " * 32]
    symbols = lmscore._symbols([b"a", b"b", b"c"])
    windows = lmscore._train_windows(iter([pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["body"])]), symbols)
    want = [[*(symbols.get(w.encode(), 1) for w in t.split()), 0] for t in texts]
    assert np.concatenate([w[1:] for w in windows]).tolist() == sum(want, [])
    assert max(map(len, windows)) == lmscore.LENGTH + 1
    at = 0
    for text in want:  # each window follows the symbol before it
        for k in range(0, len(text), lmscore.LENGTH):
            assert windows[at][0] == (text[k - 1] if k else N_SYMBOLS)
            at += 1
    assert at == len(windows)


def test_no_training_text_and_empty(spark):
    docs = frame(spark, ["a b", None])
    rows = lmscore.score_texts(docs, F.lit(False)).collect()
    assert [r["train_tokens"] for r in rows] == [0, 0] and all(np.isfinite(r["score"]) for r in rows)
    assert lmscore.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_model_beats_its_base(spark):
    rows = queries.op5_gru_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def brute_kn(counts, symbols, order):
    """Interpolated modified Kneser-Ney by definition, over n-gram dictionaries."""
    tables = [dict(counts)]
    for _ in range(order - 1):
        lower = Counter()
        for g in tables[-1]:
            lower[g[1:]] += 1
        tables.append(dict(lower))
    discounts = []
    for t in tables:
        n = [sum(c == k for c in t.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        discounts.append([0.0] + [min(max(d, 0.0), top) for d, top in zip(raw, (0.99, 1.99, 2.99))])

    def p(gram):
        if not gram:
            return 1 / symbols
        level = order - len(gram)
        t, d = tables[level], discounts[level]
        seen = {w: t.get((*gram[:-1], w), 0) for w in range(symbols)}
        total = sum(seen.values())
        if not total:
            return p(gram[1:])
        c = seen[gram[-1]]
        back = sum(d[min(x, 3)] for x in seen.values()) / total
        return (c - d[min(c, 3)]) / total + back * p(gram[1:])

    return p


def test_kneser_ney_equals_its_definition():
    rng = np.random.default_rng(6)
    symbols, order = 5, 3
    text = rng.integers(0, symbols, 400) ** 2 % symbols
    counts = np.zeros(symbols**order, np.int64)
    grams = Counter()
    for k in range(2, len(text)):
        g = tuple(int(x) for x in text[k - 2 : k + 1])
        grams[g] += 1
        counts[(g[0] * symbols + g[1]) * symbols + g[2]] += 1
    got = 10 ** knlm.smooth(counts, symbols, order).astype(float)
    p = brute_kn(grams, symbols, order)
    want = np.array([p((a, b, c)) for a in range(symbols) for b in range(symbols) for c in range(symbols)])
    assert np.abs(got - want).max() < 1e-6
    assert np.allclose(got.reshape(-1, symbols).sum(axis=1), 1, atol=1e-5)


def test_quality(spark, odd_texts, prose, with_null_id):
    junk = ["ZZ%% QQ## 7!7 @@ " * 20, "xq zj kv wq jx qz " * 30]
    texts = prose + junk + odd_texts
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(prose))] + [(0, 0, 0), (None, 1, 0), (len(prose), 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in knlm.quality(with_null_id(texts), labels).collect()}
    n = len(prose)
    assert all(rows[k]["kept"] for k in range(n)) and not rows[n]["kept"] and not rows[n + 1]["kept"]
    assert rows[n + 2]["kept"] and rows[n + 2]["perplexity"] == 1.0
    assert rows[None]["threshold"] is not None
    assert knlm.quality(frame(spark, ["a"]).limit(0), labels).count() == 0
    nothing = knlm.quality(frame(spark, ["a b", "%%"]), labels.limit(0)).collect()
    assert all(r["kept"] for r in nothing)


def test_quality_rejects_repeated_words_labelled_low(spark, prose):
    n = len(prose)
    low = [" ".join([w] * 60) for w in ("Der", "the", "was", "which", "from", "with")]
    labels = spark.createDataFrame([(k, int(k < n), 0) for k in range(n + len(low))], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in knlm.quality(frame(spark, prose + low), labels).collect()}
    assert sum(rows[k]["kept"] for k in range(n)) >= 0.95 * n
    worst = max(rows[k]["perplexity"] for k in range(n))
    assert rows[0]["threshold"] <= 1.15 * worst and not rows[n]["kept"]


def test_quality_tells_characters_beyond_the_alphabet_apart(spark, prose):
    n, seen, new = len(prose), "".join(chr(0x4E00 + k) for k in range(60)), "".join(chr(0x5E00 + k) for k in range(60))
    texts = [t + " " + seen for t in prose] + [prose[0] + " " + seen, prose[0] + " " + new]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(n)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in knlm.quality(frame(spark, texts), labels).collect()}
    assert rows[n]["n_symbols"] == rows[n + 1]["n_symbols"] and rows[n]["perplexity"] < rows[n + 1]["perplexity"]
    counts = np.zeros(0x110000, np.int64)
    counts[[ord(c) for c in "abc" + seen]] = [900, 800, 700, *range(60, 0, -1)]
    symbol = knlm.alphabet(counts)
    share = 10 ** knlm.shares(counts, symbol).astype(float)
    rare = (symbol == knlm.RARE) & (counts > 0)
    assert rare.sum() == 63 - (knlm.SYMBOLS - 4) and abs(share[rare].sum() + share[ord("z")] - 1) < 1e-5 and share[ord("a")] == 1


def test_quality_level_is_chosen_from_low_rows(spark):
    good = spark.createDataFrame([("en", float(k)) for k in range(1, 1001)], "lang string, perplexity double")
    low = spark.createDataFrame([("en", 982.5)] * 9 + [("en", 2000.0)], "lang string, perplexity double")
    assert knlm.choose(good, low)[:2] == (0.98, {"en": 980.0})
    assert knlm.choose(good, low.limit(0))[0] == knlm.LEVELS[-1]
    assert knlm.choose(good.limit(0), low)[2] == math.inf
