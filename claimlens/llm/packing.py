"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and one shorter rest. Whole windows are sequences of their own. The rests are
dealt by a hash into blocks of about ``per_block`` documents; inside a block, differencing repeatedly merges the two
partial partitions with the largest imbalance, pairing the fullest windows of one with the emptiest of the other. It
starts with as many windows as the rests need at least; while any window exceeds the capacity, the window count rises by
one.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each. Extra columns are ignored. A
null doc_id is packed and returned as null.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, body

PACK_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words that a worker remembers with their ids.
CACHE_WORDS = 1_300_000


def difference(weights: list[int], m: int, capacity: float = math.inf) -> list[list[int]] | None:
    """The indices of ``weights`` in ``m`` parts of nearly equal sums, by multiway largest differencing; None as soon as a
    part exceeds ``capacity``, as sums only grow.

    A partial partition lists only its windows that hold something, fullest first, as sum << shift | node; a node is an
    item or a pair of nodes. So the many early merges cost what they hold and not m.
    """
    n, pairs = len(weights), []
    shift = (2 * n).bit_length()  # fewer than 2n nodes
    low = (1 << shift) - 1
    heap = [(-w if m > 1 else 0, i, [w << shift | i]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, turn, b = heapq.heappop(heap)
        p, q = len(a), len(b)
        if p + q <= m:
            merged = a + b
        else:  # the fullest windows of one meet the emptiest of the other
            merged = a[: m - q] + b[: m - p]
            for x, y in zip(a[m - q :], reversed(b[m - p :]), strict=True):
                u, v = x & low, y & low
                merged.append(x - u + y - v | n + len(pairs))
                pairs.append((u, v))
        merged.sort(reverse=True)
        most = merged[0] >> shift
        if most > capacity:
            return None
        least = merged[-1] >> shift if len(merged) == m else 0
        heapq.heappush(heap, (least - most, turn, merged))
    parts: list[list[int]] = []
    for window in heap[0][2] if heap else []:
        part, todo = [], [window & low]
        while todo:
            x = todo.pop()
            if x < n:
                part.append(x)
            else:
                todo += pairs[x - n][::-1]
        parts.append(part)
    return parts + [[] for _ in range(m - len(parts))]


def least_count(weights: list[int], capacity: int) -> int:
    """A number of parts that no packing can do without: the sum's, and that of the items over each k-th of the capacity,
    of which fewer than k fit together."""
    ordered = sorted(weights, reverse=True)
    m = max(1, -(-sum(ordered) // capacity))
    for k in range(2, 17):
        over = bisect.bisect_left(ordered, -capacity, key=lambda w: -k * w)
        m = max(m, -(-over // (k - 1)))
    return m


def fill(weights: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``: the count starts at ``least_count`` and rises by one while a part exceeds it."""
    m = least_count(weights, capacity)
    while (parts := difference(weights, m, capacity)) is None:
        m += 1
    return [p for p in parts if p]


#: Characters of words that are split here: printable Latin-1 but the apostrophe (contractions) and "<" (special strings).
#: They are composed already, and lower() changes them one by one. Any other word goes to the library as it is.
PLAIN = re.compile(r"[\x21-\x26\x28-\x3b\x3d-\x7e\xa1-\xff]+")
PIECE = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_STATE: dict = {}


class WordIds:
    """Text bytes -> its ids as little-endian 32-bit bytes, through a memo of words.

    Exact for this vocabulary: normalisation and pre-tokens never reach across ASCII white space, white space gives no
    token, and the last id of each pre-token, and no other, carries the end-of-word mark. So all pre-tokens that are new
    are encoded in one call, with spaces between them, and told apart by that mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same merges for pre-tokens that are split and normalised already; white space parts them
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordIds:
        if _STATE.get("path") != path:
            _STATE.update(path=path, ids=cls(path))
        return _STATE["ids"]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens, many to a call."""
        out: list[bytes] = []
        joined = [" ".join(pieces[k : k + 400]) for k in range(0, len(pieces), 400)]
        for k in range(0, len(joined), 16):
            for e in self.merges.encode_batch_fast(joined[k : k + 16], add_special_tokens=False):
                ids = np.asarray(e.ids, "<u4")
                cut = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
                out += map(ids.tobytes().__getitem__, map(slice, [0, *cut], cut))
        return out

    def _learn(self, words: set[bytes]) -> None:
        memo = self.words
        letters = {w for w in words if w.isalpha() and w.islower()}  # ASCII letters: one pre-token
        rest = words - letters
        # the same with one comma or stop behind them: two pre-tokens
        tailed = [w for w in rest if w[-1:] in (b",", b".") and w[:-1].isalpha() and w.islower()]
        letters.update(x for x in (w[:-1] for w in tailed) if x not in memo)
        letters.update((b",", b"."))
        memo.update(zip(letters, self._encoded(b" ".join(letters).decode().split(" ")), strict=True))
        memo.update((w, memo[w[:-1]] + memo[w[-1:]]) for w in tailed)
        split: list[tuple[bytes, list[bytes]]] = []
        other: list[bytes] = []
        for w in rest.difference(tailed):
            s = w.decode(errors="replace")
            if PLAIN.fullmatch(s):
                split.append((w, [p.encode() for p in PIECE.findall(s.lower())]))
            else:
                other.append(w)
        new = list({p for _, ps in split for p in ps if p not in memo})
        memo.update(zip(new, self._encoded([p.decode() for p in new]), strict=True))
        for w, ps in split:
            memo[w] = b"".join([memo[p] for p in ps])
        for w, e in zip(other, self.tok.encode_batch_fast([w.decode(errors="replace") for w in other], add_special_tokens=False), strict=True):
            self.words[w] = np.asarray(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # lowering A-Z first keeps the memo smaller; it must not turn other text into a special string
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = set().union(*cut).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = set().union(*cut)
        self._learn(new)
        # itemgetter looks all words up in one call; it returns no tuple for a single one
        return [b"".join(itemgetter(*ws)(self.words)) if len(ws) > 1 else b"".join(self.words[w] for w in ws) for ws in cut]


def tokenized(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, crcs: the CRC-32 of each whole window and of the rest, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        encode, end = WordIds.load(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, "body", 2_000_000):
            counts, crcs = [], []
            for ids in encode(batch.column(1).to_pylist()):
                ids += end
                counts.append(len(ids) // 4)
                crcs.append([zlib.crc32(memoryview(ids)[k : k + 4 * capacity]) for k in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return docs.select("doc_id", body().alias("body")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 2, per_block: int = 1000) -> DataFrame:
    """One row per piece; sequence_id = block * 2^32 + number inside the block."""
    rows = docs.select("doc_id").count()
    n_blocks = blocks_for(rows, per_block)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
        if not table.num_rows:
            return pa.table({f: pa.array([], pa.int64()) for f in names})
        base = table.column("block")[0].as_py() << 32
        out, rest, number = [], [], 0
        for doc_id, tokens, crcs in zip(table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist(), table.column("crcs").to_pylist(), strict=True):
            for k, crc in enumerate(crcs):
                length = min(capacity, tokens - k * capacity)
                if length == capacity:
                    out.append((doc_id, k * capacity, length, crc, tokens, base + number, 0))
                    number += 1
                else:
                    rest.append((doc_id, k * capacity, length, crc, tokens))
        for part in fill([r[2] for r in rest], capacity):
            at = 0
            for i in sorted(part):
                out.append((*rest[i], base + number, at))
                at += rest[i][2]
            number += 1
        return pa.table({f: pa.array(c, pa.int64()) for f, c in zip(names, zip(*out, strict=True), strict=True)})

    names = [x.split()[0] for x in PACK_SCHEMA.split(", ")]
    # rows with a null id are spread by their token count
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.hash("crcs"))), F.lit(n_blocks)).alias("block")
    return tokenized(docs, vocabulary, capacity, end_id).select("*", block).groupBy("block").applyInArrow(run, PACK_SCHEMA)
