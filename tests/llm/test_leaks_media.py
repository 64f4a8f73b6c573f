import hashlib
import random
import struct
import zlib

import pytest

from claimlens.llm import decontam, media, queries

from .conftest import WORDS, frame


def edits(a, b):
    """Least edit distance of a to a substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        d, end = decontam.myers(decontam.masks(a), len(a), b)
        assert d == edits(a, b)
        assert d == len(a) or d == edits(a, b[:end])


def test_matches_equal_brute_force():
    rng = random.Random(2)
    items = [(k, decontam.normalise(" ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(20)))) for k in range(12)]
    matcher = decontam.Matcher(items, 0.05)
    for _ in range(150):
        _, item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "zz"])
        text = decontam.normalise("before it " + "".join(chars) + " and after")
        got = {(m[0], m[1]) for m in matcher.find(text)}
        assert got == {(k, d) for k, t in items if (d := edits(t, text)) <= int(0.05 * len(t))}


def test_operator(spark, odd_texts, with_null_id):
    item = "The quick brown fox, it jumps over the lazy dog and then it sleeps for a very long time indeed."
    bench = spark.createDataFrame([(0, item, "x"), (1, None, "x"), (2, "", "x"), (3, item, "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    texts = odd_texts + ["Intro.\n" + item.upper().replace(" ", "\n ") + " Outro", item.replace("lazy", "lzay"), item[:60]]
    n = len(odd_texts)
    rows = decontam.find_leaks(with_null_id(texts), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == {(n, 0, 0), (n, 3, 0), (n + 1, 0, 2), (n + 1, 3, 2)}
    r = next(r for r in rows if r["doc_id"] == n)
    assert decontam.normalise(texts[n])[r["match_start"] : r["match_end"]] == decontam.normalise(item)
    many = decontam.find_leaks(frame(spark, texts), bench, slab_chars=10)  # a slab for each item
    assert many.count() == len(rows)
    kept = decontam.decontaminate(with_null_id(texts), bench, slab_chars=60)
    assert kept.count() == len(texts) + 1 - 2 and "sig" in kept.columns
    assert decontam.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontam.find_leaks(frame(spark, texts).limit(0), bench).count() == 0


def png(payload=b"\0\1\2"):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b";"
BMP = b"BM" + struct.pack("<IIIIIIHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0\0\x04JF" + b"\xff\xc0\0\x05\x08\0\1" + b"\xff\xda\0\x03\1" + b"\x11\xff\0\x22" + b"\xff\xd9"
PDF = b"%PDF-1.4\nx\nstartxref\n1\n%%EOF"
GZIP = zlib.compressobj(6, zlib.DEFLATED, 31)
GZIP = GZIP.compress(b"hello") + GZIP.flush()
SAMPLES = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "application/gzip": GZIP, "audio/wav": media.wav(b"abc" * 9)}


@pytest.mark.parametrize("kind", SAMPLES)
def test_sniffing_and_carving(kind):
    raw = SAMPLES[kind]
    sniffer = media.Sniffer()
    assert sniffer.correct(raw, "text/plain") == kind
    found = [f for f in sniffer.find(b"junk BM RIFF " + raw + b" tail GIF89a") if f.kind == kind]
    assert [(f.start, f.length, f.depth) for f in found] == [(13, len(raw), 0)]
    assert not [f for f in sniffer.find(raw[:-1]) if f.kind == kind]  # cut short


def test_a_broken_checksum_is_refused():
    bad = bytearray(png())
    bad[40] ^= 1
    assert media.Sniffer().find(bytes(bad)) == []


def test_sniff_operator(spark):
    nested = media.wav(png())
    rows = spark.createDataFrame([(1, "image/png", bytearray(nested), "x"), (2, "a/b", None, "x"), (3, None, bytearray(b""), "x"), (4, "text/plain", bytearray(b"see " + GIF), "x")], "doc_id long, declared string, content binary, start string")
    got = {}
    for r in media.sniff(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["actual"], r["start"], r["length"], r["depth"], r["media"] is not None))
    assert got == {1: [("audio/wav", 0, len(nested), 0, True), ("audio/wav", 44, len(png()), 1, False)], 2: [("a/b", None, None, None, False)], 3: [(None, None, None, None, False)], 4: [("text/plain", 4, len(GIF), 0, True)]}


def test_stored_texts_round_trip(spark, odd_texts, with_null_id):
    texts = odd_texts + ["RIFF BM GIF89a"]
    rows = {r["doc_id"]: r for r in media.digest(media.store_texts(with_null_id(texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.wav(payload)), hashlib.sha256(media.wav(payload)).hexdigest())
    assert rows[5]["feature"] == rows[6]["feature"] and rows[0]["feature"] == rows[1]["feature"]
    assert media.digest(media.store_texts(frame(spark, ["a"]).limit(0))).count() == 0


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
        "op8_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op9_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    }
    for name, columns in want.items():
        assert columns <= set(queries.queries()[name](spark, sf).columns)


def test_rows_are_kept_where_they_are(spark, odd_texts, with_null_id):
    from claimlens.llm.common import keep_rows

    rows = with_null_id(odd_texts)
    out = keep_rows(rows, lambda: lambda text: "same" not in text)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in rows.collect() if "same" not in (r["text"] or ""))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert keep_rows(rows.limit(0), lambda: lambda text: True).count() == 0
