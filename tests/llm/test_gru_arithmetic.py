import numpy as np

from claimlens.llm import gru
from claimlens.llm.gru import CLASSES, HIDDEN, PER_CLASS, Gru


def test_outputs_far_apart_do_not_underflow_and_windows_reuse_their_room():
    rng = np.random.default_rng(3)
    gru = Gru(seed=4)
    gru.p["cls_bias"][:] = rng.normal(0, 200, CLASSES)
    gru.p["within_bias"][:] = rng.normal(0, 200, (CLASSES, PER_CLASS))
    h, target = rng.normal(0, 1, (500, HIDDEN)).astype(np.float32), rng.integers(0, CLASSES * PER_CLASS, 500)
    got = gru._log_probs(h, target)
    k, j = target // PER_CLASS, target % PER_CLASS
    a = h.astype(float) @ gru.p["cls"] + gru.p["cls_bias"]
    b = np.einsum("nh,nhj->nj", h.astype(float), gru.p["within"][k]) + gru.p["within_bias"][k]
    log_sum = lambda v: np.log(np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1)) + v.max(axis=1)
    want = a[np.arange(500), k] - log_sum(a) + b[np.arange(500), j] - log_sum(b)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-2)
    gru = Gru(seed=4)
    x, y = rng.integers(0, 1024, (6, 8)), rng.integers(0, 1024, (6, 8))
    loss, first = gru.gradient(x, y)
    room = gru.room
    again, second = gru.gradient(x, y)
    assert gru.room is room and loss == again and np.array_equal(first, second)


def test_scores_do_not_depend_on_how_many_states_go_together(monkeypatch):
    rng = np.random.default_rng(6)
    made = Gru(rng.normal(0, 0.3, len(Gru().flat)))
    texts = [rng.integers(0, CLASSES * PER_CLASS, n).astype(np.int16) for n in (300, 1, 0, 64, 65, 130, 7, 300)]
    want = made.score(texts)
    assert want[2] == 0 and (want[[0, 1, 3]] < 0).all()
    for together, part in ((1, 1), (5, 3), (16, 64), (700, 50)):
        monkeypatch.setattr(gru, "TOGETHER", together)
        monkeypatch.setattr(gru, "PART", part)
        assert np.allclose(made.score(texts), want, rtol=1e-5) and np.allclose(made.score(texts, together=3), want, rtol=1e-5)
    x, y = rng.integers(0, 1025, (6, 8)), rng.integers(-1, 1024, (6, 8))
    parts = made.gradient(x, y)
    monkeypatch.setattr(gru, "PART", 2048)
    whole = made.gradient(x, y)
    assert abs(parts[0] / whole[0] - 1) < 1e-5 and np.allclose(parts[1], whole[1], atol=1e-6)


def test_gates_beyond_the_range_of_exp_are_shut_or_open():
    made = Gru(np.random.default_rng(7).normal(0, 0.3, len(Gru().flat)))
    made.p["inputs"][:] = np.random.default_rng(8).choice([-500, 500], made.p["inputs"].shape)
    texts = [np.arange(40, dtype=np.int16)]
    with np.errstate(all="raise", under="ignore"):
        score, (loss, slope) = made.score(texts), made.gradient(np.append(1024, texts[0][:-1])[None], texts[0][None])
    assert np.isfinite(slope).all() and abs(-loss * 40 / score[0] - 1) < 1e-5
