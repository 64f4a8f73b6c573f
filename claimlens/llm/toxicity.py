"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model over a sentence's distinct words, each seen as itself and as its first
four and five letters (stems that take many endings), gives it a probability p; the document
is toxic with probability 1 - prod(1 - p) (noisy-or). Only documents carry labels: the gradient of the noisy-or likelihood
shares the blame among a document's sentences, and an L1 penalty leaves few words with a weight. The same p then point out
the offending sentences.

Training reads a bounded sample: at most ``max_per_class`` labelled documents of each class, those with the smallest hash
of their id, of at most ``max_chars`` characters. Every whole text is scored.

Defined results: null, empty and wordless texts have no sentences and score 0; a repeated label row counts once; a document
with both labels counts as toxic; with no labels of both classes to learn from, every document scores 0. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, keep_rows, sample_ids

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
SCORE_SCHEMA = (
    "doc_id long, score double, n_sentences long, n_flagged long, worst_start long, worst_end long, worst_score double"
)


#: Lengths of the word beginnings that are features beside the whole word.
STEMS = (4, 5)
#: Words whose logit a worker remembers.
MEMO_WORDS = 500_000


def features(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in STEMS if len(word) >= n]


class _Memo(dict):
    """word -> the sum of its features' weights."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = x = math.fsum(self.weights.get(f, 0.0) for f in features(word))
        return x


@dataclass
class ToxicityModel:
    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._memo = _Memo(self.weights)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold a weighted word."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self._logit(m[0])
            if z is not None:
                out.append((*m.span(), 1 / (1 + math.exp(-max(z, -700)))))
        return out

    def _logit(self, sentence: str) -> float | None:
        hits = math.fsum(map(self._memo.__getitem__, set(WORD.findall(sentence.lower()))))
        return self.bias + hits if hits else None

    def score(self, text: str) -> tuple[float, int, int, int | None, int | None, float]:
        """The document's probability, its sentences, those of p >= 0.5, and the worst one's place and p."""
        quiet = _softplus(self.bias)
        n, flagged, total, worst = 0, 0, 0.0, (self.bias, None, None)
        for m in SENTENCE.finditer(text):
            s = m[0]
            if s.isspace():
                continue
            n += 1
            z = self._logit(s)
            if z is None:
                total += quiet
            else:
                total += _softplus(z)
                flagged += z >= 0
                if z > worst[0]:
                    worst = (z, *m.span())
        p = 1 / (1 + math.exp(-max(worst[0], -700))) if worst[1] is not None else 0.0
        return -math.expm1(-total), n, flagged, worst[1], worst[2], p


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit(texts: list[str], labels: list[int], *, min_docs: int | None = None, min_odds: float = 4.0, steps: int = 200, refit: int = 1500, rate: float = 0.1, l1: float = 5e-4) -> ToxicityModel:
    """Proximal Adam on the mean noisy-or log-loss; weights are never negative, as a word
    that lowers a score could hide an offence elsewhere in its sentence.

    Candidates are features of ``min_docs`` toxic documents (a sixteenth of them, from 2 to 10) that favour them by ``min_odds``; the L1 penalty picks among
    them, and a second pass refits the weights without it."""
    y = np.asarray(labels, bool)
    if not y.any() or y.all():
        return ToxicityModel()
    min_docs = min_docs or max(2, min(10, int(y.sum()) // 16))

    def words_of(text: str) -> Iterator[set[str]]:
        """The distinct words of each sentence; made anew for each pass, as all features together would fill the driver."""
        return (set(WORD.findall(s)) for s in SENTENCE.findall(text.lower()) if not s.isspace())

    df: tuple[Counter, Counter] = (Counter(), Counter())
    for t, toxic in zip(texts, y, strict=True):
        df[int(toxic)].update({f for w in set().union(*words_of(t)) for f in features(w)})
    odds = lambda w: (df[1][w] + 0.5) / y.sum() / ((df[0][w] + 0.5) / (~y).sum())
    vocab = {w: k for k, w in enumerate(sorted(w for w, c in df[1].items() if c >= min_docs and odds(w) >= min_odds))}
    del df
    sent_doc, feat_sent, feat = [], [], []
    for d, t in enumerate(texts):
        for s in words_of(t):
            ks = sorted(vocab[f] for w in s for f in features(w) if f in vocab)
            feat += ks
            feat_sent += [len(sent_doc)] * len(ks)
            sent_doc.append(d)
    sent_doc, feat_sent, feat = np.asarray(sent_doc, np.int64), np.asarray(feat_sent, np.int64), np.asarray(feat, np.int64)
    n, nd = len(vocab), len(texts)
    share = np.full(nd, 1 / nd)
    w, b = np.zeros(n), -8.0
    for penalty, n_steps in ((l1, steps), (0.0, refit)):
        live = np.flatnonzero(w > 0.05) if not penalty else np.arange(n)
        place = np.full(n, -1)
        place[live] = np.arange(len(live))
        use = place[feat] >= 0
        fs, ff, w = feat_sent[use], place[feat[use]], w[live]
        # the sentences of a document without any feature are one, counted as often
        loud, fs = np.unique(fs, return_inverse=True)
        quiet = np.bincount(sent_doc, minlength=nd) - np.bincount(sent_doc[loud], minlength=nd)
        doc_of = np.concatenate([sent_doc[loud], np.arange(nd)])
        times = np.concatenate([np.ones(len(loud)), quiet])
        ns = len(times)
        m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
        for t in range(1, n_steps + 1):
            z = b + np.bincount(fs, w[ff], ns)
            lam = np.maximum(np.bincount(doc_of, times * np.logaddexp(0, z), nd), 1e-12)
            factor = np.where(y, -1 / np.expm1(np.minimum(lam, 500)), 1.0) * share
            gs = factor[doc_of] * times / (1 + np.exp(-z))
            g, gb = np.bincount(ff, gs[fs], len(w)), gs.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            step = rate / (np.sqrt(v / c2) + 1e-8)
            w -= step * m / c1
            w = np.maximum(w - penalty * step, 0)
            b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    vocab = {x: 0 for x, k in vocab.items() if place[k] >= 0}
    words = list(vocab)
    return ToxicityModel(float(b), {words[k]: float(w[k]) for k in np.flatnonzero(w > 0.05)})


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, *, max_per_class: int = 2500, max_chars: int = 12_000) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents for which ``learn_from`` (over doc_id) holds."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learn_from)
    texts = docs.select("doc_id", "text").filter((F.length("text") <= max_chars) & (F.length("text") > 0))
    known = texts.select("doc_id").join(marks, "doc_id")
    rows = []
    for label in (0, 1):
        chosen = sample_ids(known.filter(F.col("toxic") == label), max_per_class)
        # at most max_per_class ids are broadcast
        found = texts.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").select("text").collect()
        rows += [(r[0], label) for r in found]
    return fit([r[0] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """SCORE_SCHEMA, one row per document; starts and ends are code points of the worst sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(t.as_py().decode(errors="replace")) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    names = [x.split()[0] for x in SCORE_SCHEMA.split(", ")]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, SCORE_SCHEMA)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents with a score under ``threshold``; all columns stay."""
    return keep_rows(docs, lambda: lambda text: model.score(text)[0] < threshold)


def locate(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, score of every sentence with a probability of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for s in model.sentences(t.as_py().decode(errors="replace")) if s[2] >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "start", "end", "score"])

    return docs.select("doc_id", body().alias("body")).mapInArrow(run, "doc_id long, start long, end long, score double")
