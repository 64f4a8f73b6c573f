import random
import re

import numpy as np
from pyspark.sql import functions as F

from claimlens.llm import pii
from claimlens.llm.bilstm import Tagger

from .conftest import WORDS, frame


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    bits = ["a", "@", ".", "1", "255", "256", " ", "-", "+", "(", ")", "4539148803436467", "é", "x.y", "0", "\n", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("9" * 20_000 + "." + "a" * 50_000 + "@") == []  # in linear time


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    t = Tagger(20, 5)
    x, y = rng.integers(0, 20, (3, 7)), rng.integers(0, 5, (3, 7))
    _, g = t.gradient(x, y)
    for name, a in t.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), a.shape)
        keep = a[at]
        a[at] = keep + 1e-2
        up = t.gradient(x, y)[0]
        a[at] = keep - 1e-2
        down = t.gradient(x, y)[0]
        a[at] = keep
        assert abs(g[name][at] - (up - down) / 2e-2) < 2e-3


def test_reconcile_takes_the_best_set():
    spans = [(0, 0, 10, 0.9), (0, 5, 8, 1.0), (1, 10, 20, 0.5), (0, 12, 22, 0.95), (0, 0, 10, 0.9)]
    assert pii.reconcile(spans) == [(0, 0, 10, 0.9), (0, 12, 22, 0.95)]
    assert pii.reconcile([]) == []


def test_tagger_finds_what_it_learnt(spark, odd_texts, with_null_id):
    rng = np.random.default_rng(4)
    words = lambda: " ".join(rng.choice(WORDS, 12))
    sample = [f"{words()} {pii.made_span(pii.KINDS[k % 4], rng)} {words()}" for k in range(600)]
    sample = [t for t in sample if pii.base_spans(t)]  # other shapes would be labelled as none
    finder = pii.Finder(pii.train(sample))
    rng = np.random.default_rng(9)
    hits = total = 0
    for k in range(80):
        kind = pii.KINDS[k % 4]
        text = "and then we have " + pii.made_span(kind, rng) + " in the text"
        base, spans = finder([text])[0]
        assert spans[: len(base)] == base
        total += 1
        hits += any(s[0] == kind for s in spans)
    assert hits / total > 0.65  # half of the generated spans miss the base patterns on purpose
    rows = {r["doc_id"]: r for r in pii.find(with_null_id(odd_texts + ["mail bob@x.org " * 400]), finder.tagger).collect()}
    assert len(rows) == len(odd_texts) + 2 and rows[0]["spans"] == [] and len(rows[len(odd_texts)]["base"]) == 400
    text = "call +1 (415) 555-0133 now"
    row = pii.find(frame(spark, [text]), finder.tagger).select(F.sha2(pii.joined("base"), 256), pii.joined("spans")).first()
    assert row[0] == pii.digest_of(brute(text)) and row[1] == "phone:5:22"
    assert pii.find(frame(spark, [text]).limit(0), finder.tagger).count() == 0
