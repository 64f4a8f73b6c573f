"""The evidence log as a stream: each study's chain and contents are verified as entries arrive, in whatever order (an extension)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evidence import GENESIS, entry_hash, scan

#: How long entries wait for one that is missing before them.
PATIENCE_MS = 10 * 60 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChainCheck(StatefulProcessor):
    """Judges a study's entries in the order of their numbers.

    State is where the judged chain ends, and the entries that are ahead of a gap, without their contents. They are judged as
    soon as the gap is filled; a timer gives the gap up, and then the entry behind it is a break, as it is for a batch.
    """

    def __init__(self, study: str, patience_ms: int):
        self.study, self.patience_ms = study, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "seq long, hash string")
        self.ahead = handle.getMapState("ahead", "seq long", "prev string, hash string, sound boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, last = self.end.get() if self.end.exists() else (0, GENESIS)
        out, holding = [], False
        for part in rows:
            for own, prev, digest, raw in part.sort_values(["seq", "hash"], kind="stable")[["seq", "prev", "hash", "raw"]].itertuples(index=False):
                sound = entry_hash(json.loads(raw)) == digest
                if own == seq + 1:
                    out.append(self._judged(own, prev, digest, sound, last))
                    seq, last = own, digest
                elif own <= seq or self.ahead.containsKey((int(own),)):
                    out.append(self._judged(own, prev, digest, sound, None))  # the number is taken
                else:
                    self.ahead.updateValue((int(own),), (prev, digest, bool(sound)))
                    holding = True
            seq, last = self._drain(out, seq, last)
        self.end.update((int(seq), last))
        if holding and not self._timers():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, last = self.end.get() if self.end.exists() else (0, GENESIS)
        waiting, out = [k[0] for k in self.ahead.keys()], []
        if waiting:
            seq, last = self._drain(out, min(waiting) - 1, last)
            self.end.update((int(seq), last))
            if len(waiting) > len(out):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield self._frame(key, out)

    def _timers(self) -> bool:
        return any(True for _ in self.handle.listTimers())

    def _drain(self, out: list, seq: int, last: str) -> tuple[int, str]:
        """Judge what follows seq without a gap."""
        while self.ahead.containsKey((int(seq) + 1,)):
            prev, digest, sound = self.ahead.getValue((int(seq) + 1,))
            self.ahead.removeKey((int(seq) + 1,))
            seq += 1
            out.append(self._judged(seq, prev, digest, sound, last))
            last = digest
        return seq, last

    def _judged(self, seq: int, prev: str, digest: str, sound: bool, last: str | None) -> tuple[int, list[str]]:
        return int(seq), ([] if prev == last else ["chain broken"]) + ([] if sound else ["content hash mismatch"])

    def _frame(self, key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame({self.study: pd.Series([key[0]] * len(out), dtype="object"), "seq": pd.Series([s for s, _ in out], dtype="int64"), "problems": pd.Series([p for _, p in out], dtype="object")})

    def close(self) -> None:
        pass


def verify_stream(log: DataFrame, study: str = "study", patience_ms: int = PATIENCE_MS) -> DataFrame:
    """study, seq, problems of streaming entries (study, seq, prev, hash, raw), as ``evidence.verify`` finds them in a batch.

    Needs the RocksDB state store. Entries may come late, in any order; one that comes after its gap was given up, or has a
    number that was there before, is a break.
    """
    rows = log.filter(F.col("seq").isNotNull()).select(study, "seq", "prev", "hash", "raw")
    return rows.groupBy(study).transformWithStateInPandas(ChainCheck(study, patience_ms), f"{study} string, seq long, problems array<string>", "append", "ProcessingTime")


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, patience_ms: int = PATIENCE_MS) -> None:
    """Verify what has arrived below ``source`` (JSON rows study, value) since the last call, and append it to ``sink``.

    Gaps are given up by the next call that finds new entries, of any study: with timers, batches without data never end.
    """
    lines = spark.readStream.schema("study string, value string").json(source)
    out = verify_stream(scan(lines, ["study"]), patience_ms=patience_ms)
    own = {PROVIDER: ROCKS, EMPTY_BATCHES: "false"}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():  # read when the stream starts
            spark.conf.set(name, value)
        query = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
