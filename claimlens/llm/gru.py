"""A gated recurrent language model with a class-factored output, in numpy.

Symbols are the most frequent words, the end of a text, and RARE for any other word. The output is factored:
p(symbol) = p(class | h) p(symbol | class, h), with 32 classes of 32 symbols in order of frequency. Training is truncated
backpropagation through time over windows. Training on texts and scoring both carry the state from window to window, so a
text's log probability is that of the complete text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CLASSES, PER_CLASS = 32, 32
N_SYMBOLS = CLASSES * PER_CLASS
END, RARE = 0, 1
HIDDEN = 16
#: States that scoring goes through at once, and rows of logits that are worked out at once: what the caches hold.
TOGETHER, PART = 8192, 2048


def _logistic(x: np.ndarray, top: float = 1.0) -> np.ndarray:
    """top / (1 + exp(x)) in place; an infinite exp gives 0. exp takes numpy half the time of tanh."""
    np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(top), x, out=x)


def _shift(a: np.ndarray) -> np.ndarray | float:
    """What to take off the rows (at least one) ahead of exp: one number where no row can underflow, which is faster, else each row's largest."""
    top = a.max()
    return top if top - a.min() < 60 else a.max(axis=1, keepdims=True)


def _after(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The symbol before each symbol of texts that stand end to end; N_SYMBOLS where a text begins."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[(np.cumsum(lengths) - lengths)[lengths > 0]] = N_SYMBOLS
    return out


#: Sums over rows as a product, which is faster than a sum along the short axis.
ONES = np.ones(PER_CLASS, np.float32)


class Gru:
    """Parameters by name; ``inputs`` has one more row than there are symbols, for the beginning of a text."""

    SHAPES = {
        "inputs": (N_SYMBOLS + 1, 3 * HIDDEN),
        "gates": (HIDDEN, 2 * HIDDEN),
        "cand": (HIDDEN, HIDDEN),
        "cls": (HIDDEN, CLASSES),
        "cls_bias": (CLASSES,),
        "within": (CLASSES, HIDDEN, PER_CLASS),
        "within_bias": (CLASSES, PER_CLASS),
    }

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes))
        self.flat = np.array(flat, np.float32)  # a copy of its own
        self.p = self._views(self.flat)
        self.room: list[np.ndarray] | None = None  # what ``gradient`` works in, kept from window to window

    @classmethod
    def _views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def set_frequencies(self, counts: np.ndarray) -> None:
        """Start the output at the symbols' own frequencies."""
        c = counts.reshape(CLASSES, PER_CLASS) + 0.5
        self.p["cls_bias"][:] = np.log(c.sum(axis=1) / c.sum())
        self.p["within_bias"][:] = np.log(c / c.sum(axis=1, keepdims=True))

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Input rows and recurrent weights (transposed), times what ``_logistic`` takes: sigmoid(v) = 1 / (1 + exp(-v)), tanh(v) = 2 / (1 + exp(-2 v)) - 1."""
        by = np.repeat(np.asarray([-1, -2], np.float32), [2 * HIDDEN, HIDDEN])
        return self.p["inputs"] * by, np.ascontiguousarray((np.hstack([self.p["gates"], self.p["cand"]]) * by).T)

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the symbols inside each, the biases as one row more."""
        p = self.p
        return np.vstack([p["cls"], p["cls_bias"][None]]), np.concatenate([p["within"], p["within_bias"][:, None]], axis=1)

    @staticmethod
    def _sorted(h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """States in order of their targets' classes, with a column of ones for the biases: order, where classes begin and end, states, places of class and symbol in rows of logits."""
        k = target // PER_CLASS
        order = np.argsort(k.astype(np.int16), kind="stable")
        k, row = k.take(order), np.arange(0, len(k) * PER_CLASS, PER_CLASS)
        states = np.ones((len(h), HIDDEN + 1), np.float32)
        states[:, :HIDDEN] = np.ascontiguousarray(h).take(order, axis=0)
        return order, np.searchsorted(k, np.arange(CLASSES + 1)), states, row + k, row + (target.take(order) - k * PER_CLASS)

    @staticmethod
    def _logits(states: np.ndarray, cut: np.ndarray, cls: np.ndarray, within: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[tuple[int, slice]]]]:
        """By parts of the sorted states: their place, logits of the classes and inside them, the rows of each class."""
        for low in range(0, len(states), PART):
            part = states[low : low + PART]
            inner, ends = np.empty((len(part), PER_CLASS), np.float32), (cut - low).clip(0, len(part)).tolist()
            rows = [(c, slice(*ends[c : c + 2])) for c in range(CLASSES) if ends[c] < ends[c + 1]]
            for c, at in rows:
                np.matmul(part[at], within[c], out=inner[at])
            outer = part @ cls
            outer -= _shift(outer)
            inner -= _shift(inner)
            yield slice(low, low + len(part)), outer, inner, rows

    def _log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after each state."""
        if not len(target):
            return np.zeros(0, np.float32)
        if len(target) > TOGETHER:
            cuts = range(0, len(target), TOGETHER)
            return np.concatenate([self._log_probs(h[c : c + TOGETHER], target[c : c + TOGETHER]) for c in cuts])
        order, cut, states, *places = self._sorted(h, target)
        total = np.zeros(len(target), np.float32)
        for part, *logits, _ in self._logits(states, cut, *self._outputs()):
            for a, at in zip(logits, places, strict=True):
                total[part] += a.reshape(-1).take(at[part] - part.start * PER_CLASS)
                total[part] -= np.log(np.exp(a, out=a) @ ONES)
        out = np.empty_like(total)
        out[order] = total
        return out

    def score(self, texts: list[np.ndarray], together: int = 2048) -> np.ndarray:
        """Natural log probability of each whole symbol sequence.

        Texts run in step, longest first; the state of those that go on is carried into the next window.
        """
        total = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        table, weights = self._folded()
        for g in range(0, len(order), together):
            part = [i for i in order[g : g + together] if len(texts[i])]
            if not part:
                continue
            lengths = np.asarray([len(texts[i]) for i in part])
            flat = np.concatenate([texts[i] for i in part])
            before, begin = _after(flat, lengths), np.cumsum(lengths) - lengths
            h, t0 = np.zeros((HIDDEN, len(part)), np.float32), 0
            while t0 < lengths[0]:
                live = int(np.searchsorted(-lengths, -t0, side="left"))
                steps = min(max(1, TOGETHER // live), int(lengths[0]) - t0)
                goes_on = np.arange(t0, t0 + steps)[:, None] < lengths[:live]  # texts that still have a symbol come first
                at = (np.arange(t0, t0 + steps)[:, None] + begin[:live])[goes_on]
                inputs = np.ascontiguousarray(table.take(before.take(at), axis=0).T)
                states, start = np.empty((HIDDEN, len(at)), np.float32), 0
                with np.errstate(over="ignore"):
                    for n in goes_on.sum(axis=1).tolist():
                        here, h = slice(start, start + n), h[:, :n]
                        a = weights @ h
                        zr, c = a[: 2 * HIDDEN], a[2 * HIDDEN :]
                        zr += inputs[: 2 * HIDDEN, here]
                        _logistic(zr)
                        c *= zr[HIDDEN:]
                        c += inputs[2 * HIDDEN :, here]
                        _logistic(c, 2)
                        c -= 1
                        step = h - c
                        step *= zr[:HIDDEN]
                        h = np.add(c, step, out=states[:, here])
                        start += n
                lp = self._log_probs(states.T, flat.take(at))
                total[np.asarray(part[:live])] += np.bincount(np.nonzero(goes_on)[1], lp, live)
                t0 += steps
        return total

    def gradient(self, x: np.ndarray, y: np.ndarray, state: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(mean negative log likelihood, gradient) of windows x -> y (rows of equal length; y < 0 is padding).

        Rows start from ``state``, which is left as it is after the window; a text's begin forgets what was before it.
        """
        b, steps = x.shape
        p, flat = self.p, np.zeros_like(self.flat)
        g = self._views(flat)
        table, weights = self._folded()
        read = np.ascontiguousarray(x.T).reshape(-1)
        goes_on = (x.T != N_SYMBOLS).astype(np.float32)
        if self.room is None or self.room[0].shape[::2] != (steps, b):
            self.room = [np.empty((steps, width * HIDDEN, b), np.float32) for width in (3, 1, 2, 1, 1, 1, 1, 4)]
        # a column for each row of the windows, so that gates are whole runs of memory
        inputs, before, gate, by_z, by_r, by_n, hs, da = self.room
        inputs[:] = table.take(read, axis=0).reshape(steps, b, 3 * HIDDEN).transpose(0, 2, 1)
        h = np.zeros((HIDDEN, b), np.float32) if state is None else state.T
        with np.errstate(over="ignore"):
            for t in range(steps):
                h0 = np.multiply(h, goes_on[t], out=before[t])
                a = weights @ h0
                zr = _logistic(np.add(a[: 2 * HIDDEN], inputs[t, : 2 * HIDDEN], out=gate[t]))
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                ru = np.multiply(r, a[2 * HIDDEN :], out=by_r[t])  # times -2
                n = _logistic(ru + inputs[t, 2 * HIDDEN :], 2)
                n -= 1
                step = np.subtract(h0, n, out=by_z[t])
                step *= z
                h = np.add(n, step, out=hs[t])
                # what the way back multiplies by
                shut = 1 - z
                step *= shut
                n *= n
                np.subtract(1, n, out=by_n[t])
                by_n[t] *= shut
                ru *= 0.5 * (r - 1)
        if state is not None:
            state[:] = h.T
        target = np.ascontiguousarray(y.T).reshape(-1)
        real = target >= 0
        weight = np.where(real, 1.0 / max(1, real.sum()), 0).astype(np.float32)
        order, cut, states, *places = self._sorted(hs.transpose(0, 2, 1).reshape(-1, HIDDEN), np.where(real, target, 0))
        weight, loss = weight.take(order), 0.0
        dh_sorted, dh = np.empty((len(order), HIDDEN), np.float32), np.empty((len(order), HIDDEN), np.float32)
        cls, within = self._outputs()
        own_cls, own_within = np.zeros_like(cls), np.zeros_like(within)
        for part, *logits, rows in self._logits(states, cut, cls, within):
            for q, at in zip(logits, places, strict=True):
                np.exp(q, out=q)
                total, line, at = q @ ONES, q.reshape(-1), at[part] - part.start * PER_CLASS
                loss -= (np.log(line.take(at) / total + 1e-20) * weight[part]).sum()
                q *= (weight[part] / total)[:, None]
                line[at] -= weight[part]
            outer, inner = logits
            here, d = states[part], dh_sorted[part]
            own_cls += here.T @ outer
            np.matmul(outer, p["cls"].T, out=d)
            for c, at in rows:
                own_within[c] += here[at].T @ inner[at]
                d[at] += inner[at] @ p["within"][c].T
        g["cls"][:], g["cls_bias"][:] = own_cls[:HIDDEN], own_cls[HIDDEN]
        g["within"][:], g["within_bias"][:] = own_within[:, :HIDDEN], own_within[:, HIDDEN]
        dh[order] = dh_sorted
        dh = np.ascontiguousarray(dh.reshape(steps, b, HIDDEN).transpose(0, 2, 1))
        back, recurrent = np.zeros((HIDDEN, b), np.float32), np.hstack([p["cand"], p["gates"]])
        for t in range(steps - 1, -1, -1):
            du, dz, dr, dn = da[t].reshape(4, HIDDEN, b)
            d = np.add(dh[t], back, out=dh[t])
            np.multiply(d, by_z[t], out=dz)
            np.multiply(d, by_n[t], out=dn)
            np.multiply(dn, by_r[t], out=dr)
            np.multiply(dn, gate[t, HIDDEN:], out=du)
            np.matmul(recurrent, da[t, : 3 * HIDDEN], out=back)
            d *= gate[t, :HIDDEN]
            back += d
            back *= goes_on[t]
        own = np.matmul(before, da[:, : 3 * HIDDEN].transpose(0, 2, 1)).sum(axis=0)
        g["cand"][:], g["gates"][:] = own[:, :HIDDEN], own[:, HIDDEN:]
        by = np.argsort(read.astype(np.int16), kind="stable")
        read = read.take(by)
        edges = np.flatnonzero(np.diff(read, prepend=-1))
        rows = da[:, HIDDEN:].transpose(0, 2, 1).reshape(-1, 3 * HIDDEN).take(by, axis=0)
        g["inputs"][read[edges]] = np.add.reduceat(rows, edges, axis=0)
        return float(loss), flat

    def _adam(self, rate: float):
        """A step function: Adam with clipped gradients."""
        m, v, step = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

        def update(g: np.ndarray) -> None:
            nonlocal m, v, step
            g *= min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-12))
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

        return update

    def train(self, windows: list[np.ndarray], *, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 1) -> float:
        """On single windows, in random order; a window holds its left context symbol and then its targets. Last mean loss."""
        rng, update, loss = np.random.default_rng(seed), self._adam(rate), 0.0
        for _ in range(epochs):
            order, losses = rng.permutation(len(windows)), []
            for k in range(0, len(order), batch):
                part = [windows[i] for i in order[k : k + batch]]
                x, y = np.full((len(part), max(map(len, part)) - 1), END), np.full((len(part), max(map(len, part)) - 1), -1)
                for i, w in enumerate(part):
                    x[i, : len(w) - 1], y[i, : len(w) - 1] = w[:-1], w[1:]
                one, g = self.gradient(x, y)
                update(g)
                losses.append(one)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def train_texts(self, texts: list[np.ndarray], *, rate: float = 0.003, streams: int = 256, steps: int = 32) -> int:
        """One pass over whole texts by truncated backpropagation; the number of symbols.

        The texts stand end to end, cut into ``streams`` rows that run in step; windows of ``steps`` symbols are learnt one
        after the other, and the state that a window ends with is what the next one starts from.
        """
        total = sum(map(len, texts))
        if not total:
            return 0
        flat = np.concatenate(texts)
        x = _after(flat, np.asarray([len(t) for t in texts]))
        rows = max(1, min(streams, total // steps))
        width = -(-total // rows)
        pad = rows * width - total
        x = np.append(x, np.full(pad, END, x.dtype)).reshape(rows, width)
        y = np.append(flat, np.full(pad, -1, x.dtype)).reshape(rows, width)
        state, update = np.zeros((rows, HIDDEN), np.float32), self._adam(rate)
        for t in range(0, width, steps):
            update(self.gradient(x[:, t : t + steps], y[:, t : t + steps], state)[1])
        return total
