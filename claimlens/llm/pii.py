"""Personal data: e-mail and IP addresses, card and phone numbers.

Base spans follow fixed patterns. A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled
spans, adds what the patterns' exact shapes miss (a phone number without its plus, a card number with dots). The labelled
spans are the base spans of a bounded sample of the documents, and generated ones in looser shapes, set into the sample's
own text.

Every kind has a digit or an at sign in it, so the tagger runs on windows around all of these, wherever they are in a text;
the rest holds no span by the kinds' definitions. Windows overlap by half. A window's decoded spans count unless they touch
an edge inside the text, where the next window sees them whole; what the windows say is reconciled over the whole text by
weighted interval scheduling. A span is added if the model is sure of it, it passes its kind's check of digits, and it
overlaps no base span.

Defined results: null and empty texts have no spans. Repeated rows and null ids are treated like others; extra columns are
ignored. Without any document to learn from the generated spans alone train the tagger.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Tagger
from .common import body, sample_ids

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. The look-behind keeps long digit runs linear and changes no match.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
Span = tuple[str, int, int]

WINDOW, STEP, MARGIN = 96, 48, 28
#: Least mean posterior of a span that is added; what passes must also be plausible().
SURE = 0.8
#: At most so many documents, and windows of each kind of source, train the tagger.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 1500, 500, 900
#: Printable ASCII has symbols of its own; then other letters, other digits, other white space, and the rest.
N_SYMBOLS = 101
N_TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return sum(odd[::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and (len(q := p.lstrip("0")) <= 3) and int(q or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each at sign, so the time is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = end = m.end()
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if not TRIGGER.search(text):
        return out
    out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if valid_ip(m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """The check that a span found by the tagger must pass."""
    d = digits_of(text)
    if kind == "email":
        left, at, right = text.partition("@")
        return bool(at and left.strip() and "." in right.strip(" ."))
    if kind == "ip":
        return valid_ip(re.findall(r"[0-9]+", text))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


_LOWEST = 32


def symbols(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((cps >= _LOWEST) & (cps < 127), cps - _LOWEST + 1, 0).astype(np.int64)
    for k in np.flatnonzero(out == 0).tolist():
        c = text[k]
        out[k] = 96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows that cover every trigger with a margin on both sides, half overlapping."""
    out: list[int] = []
    regions: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    for a, b in regions:
        out += range(a, max(a + 1, b - STEP), STEP)
    return out


def tags_of(spans: list[Span], start: int, length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        for i in range(max(a, start), min(b, start + length)):
            out[i - start] = 1 + 2 * k + (i > a)
    return out


def spans_of(tags: np.ndarray, post: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean posterior) of the tagged runs of a window."""
    out, k = [], 0
    while k < len(tags):
        if tags[k] and tags[k] % 2:
            kind, end = (tags[k] - 1) // 2, k + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((int(kind), k, end, float(post[k:end].mean())))
            k = end
        else:
            k += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of (kind, start, end, weight): the non-overlapping choice with the largest sum of weight times length."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends, best = [s[2] for s in found], [(0.0, -1)]
    for k, (_, a, b, w) in enumerate(found):
        before = bisect.bisect_right(ends, a, 0, k)
        take = best[before][0] + w * (b - a)
        best.append((take, k) if take > best[k][0] else (best[k][0], best[k][1]))
    out, at = [], len(found)
    while at and best[at][1] >= 0:
        k = best[at][1]
        out.append(found[k])
        at = bisect.bisect_right(ends, found[k][1], 0, k)
    return out[::-1]


class Finder:
    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def __call__(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text; all windows of the batch are decoded together."""
        rows, where = [], []
        for i, text in enumerate(texts):
            if starts := windows(text):
                ids = symbols(text)
                for a in starts:
                    row = ids[a : a + WINDOW]
                    rows.append(np.pad(row, (0, WINDOW - len(row))))
                    where.append((i, a, len(row)))
        found: dict[int, list] = {}
        for k in range(0, len(rows), 512):
            tags, post = self.tagger.decode(np.stack(rows[k : k + 512]))
            for (i, a, n), t, p in zip(where[k : k + 512], tags, post, strict=True):
                if t.any():
                    for kind, b, e, w in spans_of(t[:n], p[:n]):
                        if (b > 0 or a == 0) and (e < n or a + n == len(texts[i])):
                            found.setdefault(i, []).append((kind, a + b, a + e, w))
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            added = []
            for kind, a, b, w in reconcile(found.get(i, [])):
                while a < b and text[a].isspace():
                    a += 1
                while a < b and text[b - 1].isspace():
                    b -= 1
                name = KINDS[kind]
                if w >= SURE and plausible(name, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                    added.append((name, a, b))
            out.append((base, base + added))
        return out


def made_span(kind: str, rng: np.random.Generator) -> str:
    """A generated span; half of them in shapes that the base patterns miss."""
    number = lambda n: "".join(rng.choice(list("0123456789"), n))
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    loose = rng.random() < 0.5
    if kind == "email":
        at = " @ " if loose else "@"
        return f"{word(rng.integers(3, 9))}{rng.choice(['.', '_', ''])}{number(rng.integers(0, 3))}{at}{word(rng.integers(3, 9))}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
    if kind == "ip":
        return (" . " if loose else ".").join(str(rng.integers(1, 256)) for _ in range(4))
    if kind == "card":
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice([".", "/", "_"]) if loose else rng.choice([" ", "-", ""])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))
    plus = "" if loose else "+"
    return f"{plus}{rng.integers(1, 60)} ({number(3)}) {number(3)}-{number(4)}"


def made_noise(rng: np.random.Generator) -> str:
    """Something with digits that is no personal data."""
    number = lambda n: "".join(rng.choice(list("0123456789"), n))
    return rng.choice([number(rng.integers(1, 7)), f"{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(0, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 30)}", f"v{rng.integers(0, 9)}.{number(2)}", f"{rng.integers(1900, 2100)}-{number(2)}-{number(2)}", "".join(rng.choice(list("0123456789abcdef"), 20)), "@" + number(2), f"{number(2)}:{number(2)}:{number(2)}"])


def train(sample: list[str], seed: int = 11) -> Tagger:
    """A tagger from the base spans of the sample and from generated spans in its text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    length = 64
    for text in sample:
        if len(xs) >= SAMPLE_WINDOWS:
            break
        spans = base_spans(text)
        for m in [(a, b) for _, a, b in spans][:2] or [m.span() for m in list(TRIGGER.finditer(text))[:1]]:
            a = max(0, m[0] - int(rng.integers(4, 28)))
            row = text[a : a + length]
            xs.append(np.pad(symbols(row), (0, length - len(row))))
            ys.append(np.pad(tags_of(spans, a, len(row)), (0, length - len(row))))
    plain = [t for t in sample if len(t) > 80] or ["lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"]
    for k in range(MADE_WINDOWS):
        text = plain[int(rng.integers(len(plain)))]
        a = int(rng.integers(0, max(1, len(text) - length)))
        left, right = (re.sub(r"[0-9@+]", "", text[a + i * 20 : a + i * 20 + 44]) for i in (0, 1))
        kind = KINDS[k % len(KINDS)]
        noise = rng.random() < 0.3
        put = made_noise(rng) if noise else made_span(kind, rng)
        left = left[: int(rng.integers(0, 24))]
        row = (left + " " + put + " " + right)[:length]
        b = len(left) + 1
        spans = [] if noise else [(kind, b, b + len(put))]
        xs.append(np.pad(symbols(row), (0, length - len(row))))
        ys.append(np.pad(tags_of(spans, 0, len(row)), (0, length - len(row))))
    tagger = Tagger(N_SYMBOLS, N_TAGS)
    tagger.train(np.stack(xs), np.stack(ys), epochs=14)
    return tagger


def fit(docs: DataFrame, *, max_docs: int = SAMPLE_DOCS, max_chars: int = 8_000) -> Tagger:
    """Train on at most ``max_docs`` documents of at most ``max_chars`` characters that hold a trigger, by hash of their id."""
    usable = docs.select("doc_id", "text").filter((F.length("text") <= max_chars) & F.col("text").rlike("[0-9@]"))
    chosen = F.broadcast(sample_ids(usable, max_docs))  # at most max_docs ids
    return train([r[0] for r in usable.join(chosen, "doc_id", "left_semi").orderBy("doc_id", "text").select("text").limit(2 * max_docs).collect()])


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base, spans: lists of (kind, start, end) in code points, end exclusive, by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tagger)
        order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in order(spans)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                got = finder([t.decode(errors="replace") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([as_rows(b) for b, _ in got], kind), pa.array([as_rows(s) for _, s in got], kind)], names=["doc_id", "base", "spans"])

    struct = "array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, f"doc_id long, base {struct}, spans {struct}")


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_of(spans: list[Span]) -> str:
    """The hash of a text's base spans as the query gives it."""
    spans = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
