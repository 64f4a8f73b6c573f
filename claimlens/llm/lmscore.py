"""Scores of whole texts under a word unigram base and a gated recurrent model of the training texts.

1. Texts are dealt by a hash of their id into blocks of about ``BLOCK_BYTES``, so what a block holds does not depend on the
   files or partitions they come from. Its words are cut once and numbered: the numbered words with their counts in its
   training texts are its share of the vocabulary, its texts go on as sequences of these numbers.
2. Shares meet in shards keyed by word: this gives each word's corpus count, and each block gets back the counts of just
   its own words. Words with a share of ``HOT`` of the tokens or more (1 / HOT of them at most) have a row from nearly every
   block: they are summed ahead of the shuffle and given back by broadcast. No other vocabulary is broadcast or collected.
3. The recurrent model's symbols are the most frequent words (a fixed number, of at least 1 / 200,000 of the tokens). It is
   started on the driver on a bounded number of windows, then trained in every block on all words and ends of its training
   texts, in the order of their ids, the state carried from window to window; the parameters are averaged over the blocks,
   weighted by symbols, in shards. So training grows with the input and is the same for any layout of it.
4. Each block's texts are scored whole. A rare word costs the probability of RARE times its share of the rare words' mass
   under the base, so the model is a distribution over the same words as the base.

Defined results: null and empty texts are the end token alone. Without training text all counts are 0 and the base is
uniform over one unseen token; the recurrent model then keeps its start. Rows with a null id are scored but never learnt
from; repeated rows are each counted and scored. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, body, materialize, sample_ids, slices
from .gru import END, N_SYMBOLS, RARE, Gru

BLOCK_BYTES = 12_000_000
#: The end token, as a word that no text can hold.
END_WORD = b" "
#: Share of the training tokens from which a word counts as hot.
HOT = 1 / 20_000
#: Windows of the start on the driver, and their length.
START_WINDOWS, START_EPOCHS, LENGTH = 6_000, 4, 32
SHARD = 4096  # parameters averaged together
#: Least share of the training tokens of a word that is a symbol.
LEAST = 1 / 200_000
#: Words of the texts that stand in one row together, a longer text alone.
PART_WORDS = 500_000
CODED_SCHEMA = "block int, word binary, id int, n long, doc_ids array<long>, learn array<boolean>, lengths array<long>, packed binary"
SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base_sum double, symbol_log10 double, rare_sum double, n_rare long"


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, cut at space and 9-13 only, and the end."""
    out = text.lower().split()
    out.append(END_WORD)
    return out


def _squeezed(docs: DataFrame, n_blocks: int, learn: Column) -> DataFrame:
    """block, doc_ids, learn, lengths and the texts end to end, compressed: a row for each block's part of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "body", 8_000_000):
            blocks, texts = np.asarray(batch.column(0)), batch.column(3).to_pylist()
            order = np.argsort(blocks, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1)
            lists = lambda column: pa.array([column.take(pa.array(p)).to_pylist() for p in parts], pa.list_(column.type))  # noqa: B023, E731
            own = [[texts[i] for i in p.tolist()] for p in parts]
            lengths = pa.array([list(map(len, t)) for t in own], pa.list_(pa.int64()))
            packed = pa.array([squeeze.compress(b"".join(t)) for t in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([blocks[p[0]] for p in parts], pa.int32()), lists(batch.column(1)), lists(batch.column(2)), lengths, packed], names=names)

    names = ["block", "doc_ids", "learn", "lengths", "packed"]
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    block = F.pmod(F.xxhash64("doc_id", spread), F.lit(n_blocks)).cast("int").alias("block")
    rows = docs.select(block, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), body().alias("body"))
    return rows.mapInArrow(run, "block int, doc_ids array<long>, learn array<boolean>, lengths array<long>, packed binary")


def _unpacked(table: pa.Table) -> Iterator[tuple[int | None, bool, bytes]]:
    """(doc_id, learn, text) of a block's rows, one part after the other."""
    reader = zstandard.ZstdDecompressor()
    for k in range(table.num_rows):
        ids, learn, lengths = (table.column(c)[k].as_py() for c in ("doc_ids", "learn", "lengths"))
        flat, at = reader.decompress(table.column("packed")[k].as_py(), max_output_size=sum(lengths)) if sum(lengths) else b"", 0
        for doc_id, use, n in zip(ids, learn, lengths, strict=True):
            yield doc_id, use, flat[at : at + n]
            at += n


def _code(table: pa.Table) -> pa.Table:
    """A block's distinct words (word, its number ``id`` in the block, count ``n`` in the block's training texts), and in
    other rows its texts as sequences of these numbers (parts numbered by ``id``), by document and text."""
    texts = sorted(_unpacked(table), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    index: defaultdict = defaultdict(count().__next__)
    numbers = [np.fromiter(map(index.__getitem__, w), np.int32, len(w)) for w in (words_of(t) for _, _, t in texts)]
    docs = [r[:2] for r in texts]
    del texts
    of_part = np.cumsum([len(a) for a in numbers]) // PART_WORDS
    parts = np.split(np.arange(len(docs)), np.flatnonzero(np.diff(of_part)) + 1) if docs else []
    n, packed, squeeze = np.zeros(len(index), np.int64), [], zstandard.ZstdCompressor(level=1)
    for part in parts:
        own, learn = [numbers[i] for i in part], [docs[i][1] for i in part]
        flat = np.concatenate(own)
        n += np.bincount(flat[np.repeat(learn, list(map(len, own)))], minlength=len(n))
        packed.append(squeeze.compress(flat))
    block = table.column("block")[0].as_py() if table.num_rows else 0
    words = {"block": pa.array(np.full(len(n), block, np.int32)), "word": pa.array(list(index), pa.binary()), "id": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n)}
    coded = {
        "block": pa.array([block] * len(parts), pa.int32()),
        "id": pa.array(range(len(parts)), pa.int32()),
        "doc_ids": pa.array([[docs[i][0] for i in part] for part in parts], pa.list_(pa.int64())),
        "learn": pa.array([[docs[i][1] for i in part] for part in parts], pa.list_(pa.bool_())),
        "lengths": pa.array([[len(numbers[i]) for i in part] for part in parts], pa.list_(pa.int64())),
        "packed": pa.array(packed, pa.binary()),
    }
    names = [x.split()[0] for x in CODED_SCHEMA.split(", ")]
    return pa.concat_tables([pa.table(words), pa.table(coded)], promote_options="default").select(names)


def _numbers(table: pa.Table) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, learn, word numbers) of a block's texts, in the order that ``_code`` gave them."""
    reader, table = zstandard.ZstdDecompressor(), table.sort_by("id")
    for k in range(table.num_rows):
        ids, learn, lengths = (table.column(c)[k].as_py() for c in ("doc_ids", "learn", "lengths"))
        flat = np.frombuffer(reader.decompress(table.column("packed")[k].as_py(), max_output_size=4 * sum(lengths)), np.int32)
        yield from zip(ids, learn, np.split(flat, np.cumsum(lengths)[:-1]), strict=True)


def _by_number(table: pa.Table, column: str, kind: type, rest: int = 0) -> np.ndarray:
    """A column of a block's words, by their numbers; ``rest`` for numbers without a row."""
    at = np.asarray(table.column("id"))
    out = np.full(at.max() + 1 if len(at) else 0, rest, kind)
    out[at] = np.asarray(table.column(column))
    return out


def _symbols(top: list[bytes]) -> dict[bytes, int]:
    out = {w: k + 2 for k, w in enumerate(top)}
    out[END_WORD] = END
    return out


def _train_windows(batches: Iterator[pa.RecordBatch], symbols: dict[bytes, int]) -> list[np.ndarray]:
    """Each whole text, its end included, in windows of at most LENGTH symbols, each after the symbol before it."""
    out = []
    for batch in batches:
        for text in batch.column(0):
            words = words_of(text.as_py())
            own = np.empty(len(words) + 1, np.int16)
            own[0] = N_SYMBOLS
            own[1:] = np.fromiter(map(symbols.get, words, repeat(RARE)), np.int16, len(words))
            out += [own[k : k + LENGTH + 1] for k in range(0, len(words), LENGTH)]
    return out


def _counted(shares: DataFrame, total: int) -> DataFrame:
    """Each share (block, word, n, maybe more) with its word's corpus count ``c`` and number of ``blocks``."""
    sums = [F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")]
    # tasks sum their own rows first, so a word sends a row from each task, and the sums of hot words are few
    hot = shares.filter(F.col("n") > 1).groupBy("word").agg(F.sum("n").alias("most")).filter(F.col("most") >= max(2, total * HOT)).select("word")
    hot = materialize(shares.join(F.broadcast(hot), "word", "left_semi").groupBy("word").agg(*sums), "lm-hot")
    of_word = Window.partitionBy("word")  # a word has at most one row from each block
    rare = shares.join(F.broadcast(hot.select("word")), "word", "left_anti")
    rare = rare.select(*shares.columns, F.sum("n").over(of_word).alias("c"), F.count(F.lit(1)).over(of_word).alias("blocks"))
    return rare.unionByName(shares.join(F.broadcast(hot), "word").select(rare.columns))


def train(docs: DataFrame, texts: DataFrame, known: DataFrame, learn: Column, symbols: dict[bytes, int], counts: np.ndarray) -> Gru:
    """Start on the driver, then one pass of training in every block and weighted averaging.

    ``texts`` are coded; ``known`` (block, id, symbol) has the words of each block that are no RARE ones.
    """
    spark = docs.sparkSession
    model = Gru()
    model.set_frequencies(counts)
    share = spark.sparkContext.broadcast(symbols)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [w.tobytes() for w in _train_windows(batches, share.value)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["window"])

    # the start sees windows with the smallest hashes of the texts with the smallest hashes
    first = sample_ids(docs.filter(learn), START_WINDOWS // 4)
    start = docs.filter(learn).join(F.broadcast(first), "doc_id", "left_semi").select(body().alias("body")).mapInArrow(some, "window binary").orderBy(F.xxhash64("window"), "window").limit(START_WINDOWS)
    windows = [np.frombuffer(r[0], np.int16).astype(np.int64) for r in sorted(start.collect())]
    if not windows:
        return model
    model.train(windows, epochs=START_EPOCHS)
    begun = spark.sparkContext.broadcast(model.flat)

    def more(table: pa.Table, words: pa.Table) -> pa.Table:
        symbol = np.append(_by_number(words, "symbol", np.int16, RARE), np.int16(RARE))  # the last: numbers beyond
        local = Gru(begun.value)
        n = local.train_texts([symbol[np.minimum(a, len(symbol) - 1)] for _, use, a in _numbers(table) if use])
        total = local.flat.astype(np.float64) * n
        at = range(0, len(total), SHARD)
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"shard": pa.array(range(len(at)), pa.int32()), "block": pa.array([block] * len(at), pa.int32()), "n": pa.array([n] * len(at), pa.int64()), "total": pa.array([total[k : k + SHARD].tobytes() for k in at], pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "n", "total")), strict=True))
        total = sum(np.frombuffer(x, np.float64) for _, _, x in rows) / sum(n for _, n, _ in rows)
        return pa.table({"shard": table.column("shard")[:1], "mean": pa.array([total.tobytes()], pa.binary())})

    schema = "shard int, block int, n long, total binary"
    blocks = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(more, schema).filter("n > 0")
    rows = blocks.groupBy("shard").applyInArrow(average, "shard int, mean binary").collect()
    if rows:
        model = Gru(np.concatenate([np.frombuffer(r[1], np.float64) for r in sorted(rows)]))
    return model


def _score(texts: DataFrame, known: DataFrame, model: Gru) -> DataFrame:
    """SCORE_SCHEMA by block, from its coded texts and its words' (block, id, c, symbol)."""
    share = texts.sparkSession.sparkContext.broadcast(model.flat)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        gru = Gru(share.value)
        c = _by_number(words, "c", np.float64)
        log_c = np.log10(c + 0.1)
        symbol = _by_number(words, "symbol", np.int16)
        rows, sequences, ids, place, first = [], [], [], [], {}
        for doc_id, _, at in _numbers(texts):
            ids.append(doc_id)
            place.append(first.setdefault(at.tobytes(), len(rows)))  # equal texts are scored once
            if place[-1] < len(rows):
                continue
            own = symbol[at]
            rare = own == RARE
            logs = log_c[at]
            rows.append((len(at), int((c[at] > 0).sum()), float(logs.sum()), float(logs[rare].sum()), int(rare.sum())))
            sequences.append(own)
        scores = gru.score(sequences) / math.log(10)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        long, double = pa.int64(), pa.float64()
        arrays = [pa.array(cols[0], long), pa.array(cols[1], long), pa.array(cols[2], double), pa.array(scores, double), pa.array(cols[3], double), pa.array(cols[4], long)]
        back = pa.array(place, long)
        return pa.table([pa.array(ids, long), *(x.take(back) for x in arrays)], names=names)

    names = [x.split()[0] for x in SCORE_SCHEMA.split(", ")]
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, SCORE_SCHEMA)


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``learn`` (over doc_id) marks the training rows."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    squeezed = _squeezed(docs, blocks_for(size, BLOCK_BYTES), learn)
    coded = materialize(squeezed.groupBy("block").applyInArrow(_code, CODED_SCHEMA), "lm-coded")
    texts = coded.filter(F.col("packed").isNotNull()).drop("word", "n")
    shares = coded.filter(F.col("word").isNotNull()).select("block", "word", "id", "n")
    known = materialize(_counted(shares, shares.agg(F.sum("n")).first()[0] or 0), "lm-words")
    # each word's rows add up to one
    row = known.agg(F.sum("n"), F.sum(F.when(F.col("c") > 0, 1.0 / F.col("blocks"))), F.max(F.when(F.col("word") == F.lit(END_WORD), F.col("c")))).first()
    n, v, ends = row[0] or 0, round(row[1] or 0), row[2] or 0
    log_all = math.log10(n + 0.1 * (v + 1))
    # at most 1 / LEAST words have this share of the tokens, so few rows are sorted
    frequent = known.filter((F.col("c") > 0) & (F.col("c") >= n * LEAST) & (F.col("word") != F.lit(END_WORD))).select("word", "c").distinct()
    top = frequent.orderBy(F.desc("c"), "word").limit(N_SYMBOLS - 2).collect()
    symbols = _symbols([bytes(r[0]) for r in top])
    freq = np.zeros(N_SYMBOLS)
    freq[2 : 2 + len(top)] = [r[1] for r in top]
    freq[END], freq[RARE] = ends, max(0, n - ends - sum(r[1] for r in top))
    of_word = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(w), k) for w, k in symbols.items()], "word binary, symbol int"))
    named_words = known.join(of_word, "word").select("block", "id", "symbol")
    model = train(docs, texts, named_words, F.coalesce(learn, F.lit(False)), symbols, freq)
    # the base's mass of all words that are RARE, the unseen one included
    named = (ends + 0.1 if ends else 0) + sum(r[1] + 0.1 for r in top)
    rare_mass = math.log10(max(n + 0.1 * (v + 1) - named, 0.1))
    symbol = F.coalesce("symbol", F.lit(RARE)).alias("symbol")
    out = _score(texts, known.join(of_word, "word", "left").select("block", "id", "c", symbol), model)
    base = (F.col("base_sum") - F.col("n_tokens") * F.lit(log_all)).alias("base_score")
    score = (F.col("symbol_log10") + F.col("rare_sum") - F.col("n_rare") * F.lit(rare_mass)).alias("score")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base, score)
