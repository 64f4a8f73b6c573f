"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. At each hit a format's
validator walks the structure and gives the medium's length, or refuses it. A blob that is one valid medium from its first
byte gets that type, whatever was declared; valid media inside other bytes are carved.

Defined results: null and empty blobs have no media and keep their declared type. Media inside an accepted medium are
reported as nested, not carved twice. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import body, slices

#: Magic bytes of the formats and their media types.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"\x1f\x8b\x08": "application/gzip",
}


def png_length(b: memoryview, at: int) -> int | None:
    """Chunk by chunk with its CRC, up to IEND."""
    k, first = at + 8, True
    while k + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return None
        if zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None
        k, first = k + 12 + n, False
        if kind == b"IEND":
            return k - at
    return None


def jpeg_length(b: memoryview, at: int) -> int | None:
    """Marker segments, then entropy-coded data up to EOI."""
    k, frame = at + 2, False
    while k + 4 <= len(b):
        if b[k] != 0xFF:
            return None
        marker = b[k + 1]
        if marker == 0xD9:
            return k + 2 - at if frame else None
        n = struct.unpack_from(">H", b, k + 2)[0]
        if n < 2 or not 0xC0 <= marker <= 0xFE:
            return None
        frame |= marker in (0xC0, 0xC1, 0xC2)
        k += 2 + n
        if marker == 0xDA:
            while k + 1 < len(b) and not (b[k] == 0xFF and b[k + 1] not in (0, *range(0xD0, 0xD8))):
                k += 1
    if k + 2 <= len(b) and b[k] == 0xFF and b[k + 1] == 0xD9 and frame:
        return k + 2 - at
    return None


def gif_length(b: memoryview, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    k = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x2C and k + 10 < len(b):
            k += 10 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 0x80 else 0) + 1
        elif b[k] == 0x21:
            k += 2
        else:
            return None
        while k < len(b) and b[k]:
            k += b[k] + 1
        k += 1
    return None


def wav_length(b: memoryview, at: int) -> int | None:
    """The RIFF size, and chunks inside it that fill it; format and data are needed."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, k, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while k + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, k)
        seen.add(kind)
        k += 8 + n + (n & 1)
    return end - at if k in (end, end + 1) and {b"fmt ", b"data"} <= seen else None


def bmp_length(b: memoryview, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or not 14 + header <= offset < size or at + size > len(b):
        return None
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    return size if planes == 1 and bits in (1, 4, 8, 16, 24, 32) else None


def pdf_length(b: memoryview, at: int) -> int | None:
    raw = bytes(b[at:])
    end = raw.find(b"%%EOF")
    return end + 5 if end > 0 and b"startxref" in raw[:end] else None


def gzip_length(b: memoryview, at: int) -> int | None:
    """Inflated to its end, with its checksum."""
    reader = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 65536):
            reader.decompress(b[k : k + 65536])
            if reader.eof:
                return min(len(b), k + 65536) - len(reader.unused_data) - at
    except zlib.error:
        pass
    return None


VALIDATORS: dict[str, Callable[[memoryview, int], int | None]] = {
    "image/png": png_length,
    "image/jpeg": jpeg_length,
    "image/gif": gif_length,
    "audio/wav": wav_length,
    "image/bmp": bmp_length,
    "application/pdf": pdf_length,
    "application/gzip": gzip_length,
}


@dataclass
class Found:
    kind: str
    start: int
    length: int
    depth: int


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.automaton.make_automaton()

    def find(self, blob: bytes) -> list[Found]:
        """All valid media in order of their start; depth 0 is not inside another."""
        out: list[Found] = []
        view = memoryview(blob)
        for end, (n, kind) in self.automaton.iter(blob.decode("latin-1")):
            start = end + 1 - n
            length = VALIDATORS[kind](view, start)
            if length:
                out.append(Found(kind, start, length, sum(f.start + f.length >= start + length for f in out)))
        return out

    def correct(self, blob: bytes, declared: str | None) -> str | None:
        """The type of a blob that is one medium from end to end, else what was declared."""
        whole = next((f for f in self.find(blob) if f.start == 0 and f.length == len(blob)), None)
        return whole.kind if whole else declared


def sniff(blobs: DataFrame, blob: str = "content", declared: str = "declared", key: str = "doc_id") -> DataFrame:
    """key, declared, actual, start, length, depth, media: one row per medium found, and one without for other blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for k, said, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                raw = raw or b""
                found = sniffer.find(raw)
                actual = next((f.kind for f in found if f.start == 0 and f.length == len(raw)), said)
                rows += [(k, said, actual, f.start, f.length, f.depth, raw[f.start : f.start + f.length] if not f.depth else None) for f in found]
                if not found:
                    rows.append((k, said, actual, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = f"{key} long, declared string, actual string, start long, length long, depth int, media binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return blobs.select(key, declared, blob).mapInArrow(run, schema)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit samples as a WAV file."""
    pad = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a valid WAV file."""
    k = 12
    while True:
        kind, n = struct.unpack_from("<4sI", media, k)
        if kind == b"data":
            return media[k + 8 : k + 8 + n]
        k += 8 + n + (n & 1)


def padded(raw: bytes, unit: int = 576) -> bytes:
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def features(kind: str, media: bytes, payload: bytes, found: list[Found]) -> str:
    """Type, format fields, mean, energy and crossings of the middle, and how many media lie inside."""
    rate, bits = struct.unpack_from("<I", media, 24)[0], struct.unpack_from("<H", media, 34)[0]
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    energy = int(((x.astype(np.int32) - 128) ** 2).sum())
    return f"{kind};rate={rate};bits={bits};frames={len(x)};mean={x.mean():.4f};energy={energy};crossings={int((high[1:] != high[:-1]).sum())};nested={sum(f.depth > 0 for f in found)}"


STORE_SCHEMA = "doc_id long, n_bytes long, declared string, content binary"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Each text as a media blob: WAV samples, under a type that does not say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 8_000_000):
            raw = batch.column(1).to_pylist()
            arrays = [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([declared] * len(raw)), pa.array([wav(padded(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "declared", "content"])

    return docs.select("doc_id", body().alias("body")).mapInArrow(run, STORE_SCHEMA)


def digest(stored: DataFrame) -> DataFrame:
    """Sniff each stored blob, read its samples back, and describe them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in slices(batches, "content", 8_000_000):
            rows = []
            for doc_id, n, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = sniffer.find(content)
                whole = next(f for f in found if f.start == 0)
                media = content[: whole.length]
                payload = wav_samples(media)
                sha = hashlib.sha256
                rows.append((doc_id, n, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha(media).hexdigest(), features(whole.kind, media, payload, found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    return stored.select("doc_id", "n_bytes", "declared", "content").mapInArrow(run, DIGEST_SCHEMA)
