from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from claimlens.llm import lmscore
from claimlens.llm.common import remainder

from .conftest import frame


def test_coded_texts_are_the_words_in_order(monkeypatch, odd_texts, prose):
    rows = [(k if k % 5 else None, bool(k % 3) and k % 5 > 0, t) for k, t in enumerate((t or "").encode() for t in odd_texts + prose + prose[:2])]
    rows += [(1, True, b"b a"), (1, True, b"a b")]
    pack = zstandard.ZstdCompressor().compress
    lists = [[list(column) for column in zip(*part)] for part in (rows[7:], rows[:7])]
    table = pa.table({"block": pa.array([3, 3], pa.int32()), "doc_ids": [a for a, _, _ in lists], "learn": [b for _, b, _ in lists], "lengths": [list(map(len, c)) for _, _, c in lists], "packed": [pack(b"".join(c)) for _, _, c in lists]})
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for size in (1, 50, 10**6):
        monkeypatch.setattr(lmscore, "PART_WORDS", size)
        out = lmscore._code(table)
        words, texts = out.filter(pc.is_valid(out["word"])), out.filter(pc.is_valid(out["packed"]))
        assert len(words) + len(texts) == len(out) and set(out["block"].to_pylist()) == {3}
        name = dict(zip(words["id"].to_pylist(), words["word"].to_pylist(), strict=True))
        got = [(d, use, [name[k] for k in a.tolist()]) for d, use, a in lmscore._numbers(texts.take(list(range(len(texts)))[::-1]))]
        assert got == [(d, use, lmscore.words_of(t)) for d, use, t in rows]
        learnt = Counter(w for _, use, t in rows if use for w in lmscore.words_of(t))
        assert dict(zip(words["word"].to_pylist(), words["n"].to_pylist(), strict=True)) == {w: learnt[w] for _, _, t in rows for w in lmscore.words_of(t)}


def test_scores_read_the_coded_texts_only(spark, tmp_path, prose):
    path = str(tmp_path / "documents.parquet")
    frame(spark, prose).write.parquet(path)
    out = lmscore.score_texts(spark.read.parquet(path), remainder(10) != 0)
    assert out.count() == len(prose)
    files = out.inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
