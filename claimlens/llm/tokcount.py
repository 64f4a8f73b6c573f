"""Exact token counts by compiled finite-state transducers.

The byte-level vocabulary splits a text into pieces by a fixed pattern and merges byte pairs inside each piece. The pattern
is compiled into one deterministic transducer over character classes; a transition is annotated with the pieces that it
emits (how many, and where they begin). A long run of characters is cut into chunks: each chunk is run from all states at
once, which gives its state map; maps compose associatively, so a parallel prefix scan gives every chunk its true start
state, whatever the text's length. A second run from these states emits the pieces.

Inside a piece a second transducer runs over bytes, and its transitions are annotated with the number of tokens that they
emit. It rests on a property of merge vocabularies: a sequence of tokens is a text's encoding if and only if each token, and
each two neighbours, are encoded as themselves. So the last token of a prefix is the one that ends there, fits the last
token of the prefix before it, and that prefix has one token less. A state holds what that needs: the longest suffix that
begins some token and, at each place in it, the last token and the count; a transition's count may be negative, as a longer
token takes back shorter ones. Equal states are one, so the automaton is finite; it is compiled as far as texts visit it.
Every piece begins in the start state: a chunk map of this level is constant wherever a piece begins, and the scan of the
first level gives these places.

Defined results: null and empty texts have no bytes and no tokens. The vocabulary's special strings inside a text are one
token each. Repeated rows and null ids are counted like any other; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import body, slices

CLASSES = ("other", "letter", "number", "space", "white", "apostrophe", "stmd", "r", "v", "l", "e", "end")
OTHER, LETTER, NUMBER, SPACE, WHITE, APOS, STMD, R, V, L, E, END = range(12)
LETTERS = (LETTER, STMD, R, V, L, E)
(START, WORD, NUM, SIGN, SP1, SP2, WH1, WH2, QUOTE, QUOTE_RV, QUOTE_L) = range(11)
N_STATES, N_CLASSES = 11, 12
#: Emission bits: a piece begins at this character; a piece begins at the one before it.
HERE, BEFORE = 1, 2
CHUNK = 256
#: Pieces, and states of the second transducer, that a worker keeps; beyond it they are made anew.
MEMO_PIECES, MAX_STATES = 700_000, 250_000


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) for state * N_CLASSES + class.

    SP1 and WH1 are one white-space character (a space, another), SP2 and WH2 several that end in one; QUOTE is an
    apostrophe that begins a piece, and QUOTE_RV and QUOTE_L have read the first letter of a two-letter ending after it.
    """
    nxt, out = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)
    begin = {NUMBER: NUM, OTHER: SIGN, APOS: QUOTE, SPACE: SP1, WHITE: WH1, END: START} | dict.fromkeys(LETTERS, WORD)
    glued = {NUMBER: NUM, OTHER: SIGN, APOS: SIGN} | dict.fromkeys(LETTERS, WORD)  # after a space
    for c in range(N_CLASSES):
        fresh = HERE if c != END else 0
        for state in range(N_STATES):
            to, emit = begin[c], fresh
            if (state, c) in {(NUM, NUMBER), (SIGN, OTHER), (SIGN, APOS), (QUOTE, OTHER), (QUOTE, APOS)} or state == WORD and c in LETTERS:
                to, emit = {QUOTE: SIGN}.get(state, state), 0
            elif state in (SP1, SP2, WH1, WH2):
                if c in (SPACE, WHITE):
                    to, emit = (SP2 if c == SPACE else WH2), 0
                elif c == END:
                    emit = 0
                elif state in (SP1, SP2):
                    to, emit = glued[c], BEFORE if state == SP2 else 0
                elif state == WH2:
                    emit = HERE | BEFORE
            elif state == QUOTE and c in (STMD, R, V, L):
                to, emit = {STMD: START, R: QUOTE_RV, V: QUOTE_RV, L: QUOTE_L}[c], 0
            elif (state, c) in {(QUOTE_RV, E), (QUOTE_L, L)}:
                to, emit = START, 0
            elif state in (QUOTE_RV, QUOTE_L):
                to, emit = (WORD, BEFORE) if c in LETTERS else (begin[c], fresh | BEFORE)
            nxt[state, c], out[state, c] = to, emit
    return nxt.reshape(-1), out.reshape(-1)


def classes_of() -> np.ndarray:
    """The class of each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            kinds[cp] = LETTER
        elif kind == "N":
            kinds[cp] = NUMBER
    for cp in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kinds[cp] = WHITE
    kinds[ord(" ")], kinds[ord("'")] = SPACE, APOS
    for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in chars:
            kinds[ord(x)] = c
    return kinds


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (states x chunks), by doubling: column k maps through chunks 0..k."""
    step, n = 1, maps.shape[1]
    while step < n:
        later = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :step], later], axis=1)
        step *= 2
    return maps


class Splitter:
    def __init__(self):
        nxt, self.emit = compile_splitter()
        self.next = (nxt * N_CLASSES).astype(np.uint8)  # states are kept multiplied, so that adding a class indexes
        self.kinds = classes_of()

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """True where a piece begins; ``kinds`` must end with END."""
        n = len(kinds)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.repeat((np.arange(N_STATES) * N_CLASSES).astype(np.uint8)[:, None], chunks, axis=1)
        for row in grid:
            maps = self.next[maps + row]
        after = scan_maps(maps // N_CLASSES)
        state = np.zeros(chunks, np.uint8)
        state[1:] = after[START, :-1] * N_CLASSES
        emits = np.empty_like(grid)
        for k, row in enumerate(grid):
            at = state + row
            emits[k] = self.emit[at]
            state = self.next[at]
        emits = np.ascontiguousarray(emits.T).reshape(-1)[:n]
        begin = (emits & HERE).astype(bool)
        begin[:-1] |= (emits[1:] & BEFORE).astype(bool)
        return begin


class Encoder:
    """The vocabulary's merges, by definition: the pair of lowest rank first, the leftmost of its places first."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        # the vocabulary writes bytes as printable characters: fixed by the format
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.byte = [vocab[names[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else m.split(" ") for m in model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        back = {c: b for b, c in names.items()}
        self.tokens = {bytes(back[c] for c in text): k for text, k in vocab.items() if all(c in back for c in text)}

    def encode(self, piece: bytes) -> list[int]:
        """For tokens and pairs of tokens, which are short."""
        ids = [self.byte[b] for b in piece]
        while len(ids) > 1:
            found = [(r[0], k, r[1]) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pairs.get(p))]
            if not found:
                break
            _, k, merged = min(found)
            ids[k : k + 2] = [merged]
        return ids


class Transducer:
    """Counts the tokens of a piece byte by byte; ``arcs`` maps state * 256 + byte to (next state, tokens emitted)."""

    def __init__(self, model: dict):
        self.encoder = Encoder(model)
        own = {text: k for text, k in self.encoder.tokens.items() if self.encoder.encode(text) == [k]}
        self.token, self.text = own, {k: text for text, k in own.items()}
        self.begins = {text[:n] for text in own for n in range(len(text))}
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: the suffix, and the places where a token may begin that goes on, the first one first: how many bytes ago,
        # the last token there, and the count there less the count here
        self.keys = [(b"", ((0, None, 0),))]
        self.states = {self.keys[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def _fit(self, a: int | None, b: int) -> bool:
        if a is None:  # the piece begins here
            return True
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) > 20 * MAX_STATES:
                self.fits.clear()
            fit = self.fits[a, b] = self.encoder.encode(self.text[a] + self.text[b]) == [a, b]
        return fit

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.keys[state]
        suffix += bytes([byte])
        ends = [(suffix[len(suffix) - ago - 1 :], ago, before, count) for ago, before, count in places]
        for text, _, before, count in ends:  # the longest token first
            token = self.token.get(text)
            if token is not None and self._fit(before, token):
                break
        emitted = count + 1
        open_ = [(ago + 1, before, c - emitted) for text, ago, before, c in ends if text in self.begins]
        key = (suffix[len(suffix) - open_[0][0] :] if open_ else b"", (*open_, (0, token, 0)))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        arc = self.arcs[state << 8 | byte] = (to, emitted)
        return arc

    def count(self, piece: bytes) -> int:
        if len(self.keys) > MAX_STATES:
            self._clear()
        arcs, state, total = self.arcs.get, 0, 0
        for byte in piece:
            arc = arcs(state << 8 | byte) or self._compile(state, byte)
            state = arc[0]
            total += arc[1]
        return total


class PieceCounts(dict):
    """piece -> its number of tokens, by the transducer when first met."""

    def __init__(self, model: dict):
        super().__init__()
        self.transducer = Transducer(model)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO_PIECES:
            self.clear()
        self[piece] = n = self.transducer.count(piece.encode(errors="replace"))
        return n


_LOADED: dict = {}


class Counter:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a byte-level vocabulary of the kind compiled here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter, self.pieces = Splitter(), PieceCounts(spec["model"])

    @classmethod
    def load(cls, path: str) -> Counter:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def counts(self, texts: list[str]) -> list[int]:
        out, segments, owner = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    cut = [p.split(s) for p in parts]
                    out[k] += sum(len(p) - 1 for p in cut)
                    parts = [x for p in cut for x in p]
            segments += parts
            owner += [k] * len(parts)
        joined = "\0".join(segments) + "\0"
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        kinds = self.splitter.kinds[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        kinds[ends] = END
        first = np.flatnonzero(self.splitter.starts(kinds))
        of = np.searchsorted(ends, first)
        last = np.minimum(np.append(first[1:], len(joined)), ends[of])
        emitted = np.fromiter(map(self.pieces.__getitem__, [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.int64, len(first))
        totals = np.bincount(of, emitted, len(segments)).astype(np.int64).tolist()
        for k, n in zip(owner, totals, strict=True):
            out[k] += n
        return out


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(vocabulary)
        for batch in slices(batches, "body", 2_000_000):
            raw = batch.column(1).to_pylist()
            n = counter.counts([t.decode(errors="replace") for t in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", body().alias("body")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
