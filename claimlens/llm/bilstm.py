"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Windows are rows of symbol ids of one length; symbol 0 is padding, tag 0 means outside."""

    def __init__(self, n_symbols: int, n_tags: int, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        self.p = {"out": draw(2 * h, n_tags), "out_bias": np.zeros(n_tags, np.float32), "trans": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": draw(n_symbols, 4 * h), f"rec_{d}": draw(h, 4 * h)}
            self.p[f"in_{d}"][:, h : 2 * h] += 1  # remember at first

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of one direction, in time order, with what the gradient needs."""
        rows, steps = x.shape
        h = c = np.zeros((rows, HIDDEN), np.float32)
        states, trace = np.empty((steps, rows, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = self.p[f"in_{d}"][x[:, t]] + h @ self.p[f"rec_{d}"]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            trace[t] = (h, c, i, f, o, g, tc)
            h, c = o * tc, new
            states[t] = h
        return states, trace

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, b = self._run(x, "f"), self._run(x, "b")
        h = np.concatenate([f[0], b[0]], axis=2)
        return h @ self.p["out"] + self.p["out_bias"], (h, f[1], b[1])

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward scores (steps, rows, tags), and log Z of each row."""
        trans = self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, len(e)):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[-1], 1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and the posterior of each, both (rows, steps)."""
        e, _ = self.emissions(x)
        trans, steps = self.p["trans"], len(e)
        best, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + trans
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[t]
        tags = np.empty((steps, x.shape[0]), np.int64)
        tags[-1] = best.argmax(axis=1)
        row = np.arange(x.shape[0])
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][row, tags[t]]
        alpha, beta, z = self._forward_backward(e)
        post = np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z)
        return tags.T, post.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log likelihood of the tag rows y, its gradient)."""
        rows, steps = x.shape
        e, (h, ftrace, btrace) = self.emissions(x)
        trans, n_tags = self.p["trans"], e.shape[2]
        alpha, beta, z = self._forward_backward(e)
        post = np.exp(alpha + beta - z[:, None])
        pairs = np.zeros_like(trans)
        for t in range(1, steps):
            pairs += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(axis=0)
        yt, row = y.T, np.arange(rows)
        gold = sum(e[t][row, yt[t]] for t in range(steps)) + trans[yt[:-1], yt[1:]].sum(axis=0)
        np.subtract.at(pairs, (yt[:-1], yt[1:]), 1)
        de = post - np.eye(n_tags, dtype=np.float32)[yt]
        de /= rows
        g = {"trans": pairs / rows, "out": np.tensordot(h, de, ([0, 1], [0, 1])), "out_bias": de.sum(axis=(0, 1))}
        dh = de @ self.p["out"].T
        for d, trace, part in (("f", ftrace, dh[:, :, :HIDDEN]), ("b", btrace, dh[:, :, HIDDEN:])):
            rec = self.p[f"rec_{d}"]
            da = np.empty((steps, rows, 4 * HIDDEN), np.float32)
            grec = np.zeros_like(rec)
            bh = bc = np.zeros((rows, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h0, c0, i, f, o, gg, tc = trace[t]
                up = part[t] + bh
                dc = bc + up * o * (1 - tc * tc)
                da[t] = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), up * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                grec += h0.T @ da[t]
                bh, bc = da[t] @ rec.T, dc * f
            gin = np.zeros_like(self.p[f"in_{d}"])
            np.add.at(gin, x.T.reshape(-1), da.reshape(-1, 4 * HIDDEN))
            g |= {f"in_{d}": gin, f"rec_{d}": grec}
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 4) -> float:
        """Adam with clipped gradients and a falling rate; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses, lr = rng.permutation(len(x)), [], rate * (1 - epoch / epochs)
            for k in range(0, len(x), batch):
                part = order[k : k + batch]
                one, g = self.gradient(x[part], y[part])
                scale = min(1.0, 5.0 / (float(np.sqrt(sum((a * a).sum() for a in g.values()))) + 1e-9))
                step += 1
                for name, a in g.items():
                    a = a * scale
                    m[name] += 0.1 * (a - m[name])
                    v[name] += 0.01 * (a * a - v[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                losses.append(one)
            loss = float(np.mean(losses))
        return loss
