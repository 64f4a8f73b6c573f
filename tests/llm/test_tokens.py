import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimlens.llm import packing, tokcount

from .conftest import frame

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["'s", "'ll", "'", "s", "t", "re", "ve", "l", "d", "m", "a", "Zz", "é", "É", "5", "½", "…", "!", "_", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "日", "́", "😀", "Σ", "İ", "ﬁ", "x" * 70, "%%%", "."]


def fuzz(n):
    rng = random.Random(3)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(odd_texts):
    texts = fuzz(4000) + [t or "" for t in odd_texts]
    lib = Tokenizer.from_file(BYTES)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    counter = tokcount.Counter(BYTES)
    assert counter.counts(texts) == want
    assert [counter.counts([t])[0] for t in texts[:200]] == want[:200]


def test_prefix_scan_equals_one_run():
    s = tokcount.Splitter()
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, tokcount.N_CLASSES, 5000).astype(np.uint8)
    kinds[-1] = tokcount.END
    state, want = 0, np.zeros(len(kinds), bool)
    for i, c in enumerate(kinds.tolist()):
        emit = s.emit[state * tokcount.N_CLASSES + c]
        want[i] |= bool(emit & tokcount.HERE)
        if emit & tokcount.BEFORE:
            want[i - 1] = True
        state = s.next[state * tokcount.N_CLASSES + c] // tokcount.N_CLASSES
    assert (s.starts(kinds) == want).all()


def test_count_operator(spark, odd_texts, with_null_id):
    rows = {r["doc_id"]: r for r in tokcount.count_tokens(with_null_id(odd_texts), BYTES).collect()}
    lib = Tokenizer.from_file(BYTES)
    for k, t in enumerate(odd_texts):
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"]) == (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
    assert None in rows and tokcount.count_tokens(frame(spark, ["a"]).limit(0), BYTES).count() == 0


def test_word_ids_equal_the_library(odd_texts):
    texts = fuzz(4000) + [t or "" for t in odd_texts]
    lib = Tokenizer.from_file(WORDS)
    got = packing.WordIds(WORDS)([t.encode() for t in texts])
    for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert g == np.asarray(e.ids, "<u4").tobytes(), t


def test_differencing():
    parts = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4]
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts)
    assert sums[1] - sums[0] <= 2
    rng = random.Random(1)
    weights = [rng.randint(1, 4095) for _ in range(600)]
    filled = packing.fill(weights, 4096)
    assert sorted(i for p in filled for i in p) == list(range(600)) and max(sum(weights[i] for i in p) for p in filled) <= 4096
    assert sum(weights) / (4096 * len(filled)) > 0.95
    assert packing.fill([], 10) == [] and sorted(packing.fill([10, 10], 10)) == [[0], [1]]


def test_a_third_of_equal_long_rests():
    rng = random.Random(2)
    weights = [3000] * 333 + [rng.randint(50, 750) for _ in range(667)]
    filled = packing.fill(weights, 4096)
    assert sorted(i for p in filled for i in p) == list(range(1000)) and max(sum(weights[i] for i in p) for p in filled) <= 4096
    assert len(filled) == packing.least_count(weights, 4096) == 333
    assert len(packing.fill([1366] * 1000, 4096)) == 500
    # the least count that fits: one less does not
    weights = [min(4095, int(rng.lognormvariate(6, 1)) + 1) for _ in range(300)]
    m = len(packing.fill(weights, 4096))
    assert m == packing.least_count(weights, 4096) or packing.difference(weights, m - 1, 4096) is None


def check_pack(rows, texts, capacity):
    lib = Tokenizer.from_file(WORDS)
    ids = {k: np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == len(own)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_operator(spark, odd_texts, prose, with_null_id, capacity):
    texts = [t for t in odd_texts + prose if len(t or "") < 40_000]
    rows = packing.pack(with_null_id(texts), WORDS, capacity=capacity, per_block=20).collect()
    check_pack(rows, dict(enumerate(texts)) | {None: "null id"}, capacity)
    assert packing.pack(frame(spark, ["a"]).limit(0), WORDS).count() == 0


def test_repeated_rows_are_each_packed(spark):
    df = frame(spark, ["a b c"])
    assert packing.pack(df.union(df), WORDS).count() == 2


def test_transducer_emits_what_merging_gives():
    transducer = tokcount.Counter.load(public_tokenizers.path("byte_bpe_50k.json")).pieces.transducer
    rng = random.Random(3)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))).encode() for letters in ("etaoinshr", "0123456789", "=-_", "aé日😀 ", "xX") for _ in range(200)]
    assert [transducer.count(p) for p in pieces] == [len(transducer.encoder.encode(p)) for p in pieces]
    # an arc may take tokens back, and its count is what the whole prefix gains
    assert min(n for _, n in transducer.arcs.values()) < 0 < max(n for _, n in transducer.arcs.values())
    # the automaton is finite: a run of one letter comes to a cycle
    before = len(transducer.keys)
    assert transducer.count(b"=" * 100_000) > 0 and len(transducer.keys) - before < 600
