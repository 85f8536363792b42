"""Structured Streaming: tags of arriving spectra, progress, windowed tallies, de-duplication, repeat gaps."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ionweave.operators.tagging import TagParams
from ionweave.plans import tag_run
from ionweave.sources.readers import parse_mgf_blocks, peaks_of


def stream_tags(stream: DataFrame, tag_path: str, error_path: str, checkpoint: str, params: TagParams = TagParams()):
    """Tags every micro-batch of spectra (the spectra layout, optional ``_corrupt``); starts the query.

    Malformed blocks go to ``error_path`` and the stream goes on. Each batch writes under its own id, so
    a batch repeated after a failure replaces its files.
    """
    def tag(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good = batch.filter(F.col("_corrupt").isNull()) if "_corrupt" in batch.columns else batch
        spectra = good.withColumn("spectrum", F.col("spectrum_id"))
        tag_run.tag_spectra(spectra, peaks_of(good), params).write.mode("overwrite").parquet(f"{tag_path}/batch={epoch}")
        if "_corrupt" in batch.columns:
            batch.filter(F.col("_corrupt").isNotNull()).select("run_id", "idx", F.col("_corrupt").alias("error")).write.mode("overwrite").parquet(f"{error_path}/batch={epoch}")
        batch.unpersist()
    return stream.writeStream.foreachBatch(tag).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mgf_stream(spark, path: str) -> DataFrame:
    """A stream of MGF blocks from a directory of arriving files."""
    raw = spark.readStream.option("lineSep", "END IONS").text(path).select(F.input_file_name().alias("file"), F.xxhash64("value").alias("idx"), "value")
    return parse_mgf_blocks(raw.filter(F.trim("value") != "")).drop("file")


def stream_progress(stream: DataFrame) -> DataFrame:
    """Running spectra and tagged counts per run (update mode)."""
    return stream.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("status") == "tagged").alias("tagged"))


def stream_census(stream: DataFrame, window: str = "10 minutes", slide: str | None = None, session: str | None = None, lateness: str = "30 minutes") -> DataFrame:
    """Counts by status per run and event-time window: tumbling, sliding, or session windows per run."""
    w = F.session_window("ts", session) if session else F.window("ts", window, slide) if slide else F.window("ts", window)
    keys = [w.alias("w"), "run_id"] if session else [w.alias("w"), "run_id", "status"]
    g = stream.withWatermark("ts", lateness).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rest = [c for c in g.columns if c != "w"]
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *rest)


def stream_dedupe(stream: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """One row per spectrum within the lateness bound."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run_id", "idx"])


GAP_SCHEMA = "run_id long, kx long, event long, gap long"
#: A key that was not selected for so long is forgotten.
FORGET_AFTER = 24 * 3600 * 1000


#: m/z keys that share an entry of the state's map. A visit to the store costs far more than a key.
CELL = 256


class RepeatGaps(StatefulProcessor):
    """Events and repeat gaps of one run as they come.

    State: the run's counter (events so far, last m/z key, last position), and a map from cells of m/z keys to each key's last event and
    when it came, so a batch reads and writes the cells that it touches and no others. A key whose event is older than ``forget_after``
    milliseconds counts as new and leaves its cell when that is next written; untouched cells and runs expire as a whole.
    """

    def __init__(self, forget_after: int):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n long, kx long, pos long", self.forget_after)
        self.seen = handle.getMapState("seen", "cell long", "kx array<long>, event array<long>, at array<long>", self.forget_after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, last, upto = self.run.get() if self.run.exists() else (0, None, None)
        new = pd.concat(list(rows)).sort_values("pos", kind="stable", ignore_index=True)
        late = new["pos"] <= upto if upto is not None else pd.Series(False, new.index)
        for kx in new.loc[late, "kx"].tolist():
            yield gap_rows([(key[0], kx, None, None)])
        new = new[~late]
        if not len(new):
            return
        kxs, ev = new["kx"].tolist(), []
        for before, kx in zip([last, *kxs], kxs, strict=False):
            if kx != before:
                ev.append((n + len(ev) + 1, kx))
        out = []
        for cell, part in pd.DataFrame(ev, columns=["event", "kx"]).groupby(lambda i: ev[i][1] // CELL):
            held = self.seen.getValue((int(cell),)) if self.seen.containsKey((int(cell),)) else ([], [], [])
            known = {k: (e, t) for k, e, t in zip(*held, strict=True) if now - t < self.forget_after}
            for event, kx in part.itertuples(index=False):
                if kx in known:
                    out.append((key[0], kx, event, event - known[kx][0]))
                known[kx] = (event, now)
            self.seen.updateValue((int(cell),), (list(map(int, known)), [int(e) for e, _ in known.values()], [int(t) for _, t in known.values()]))
        self.run.update((n + len(ev), int(kxs[-1]), int(new["pos"].iloc[-1])))
        yield gap_rows(out)

    def close(self) -> None:
        pass


def gap_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run_id", "kx", "event", "gap"]).astype("Int64")


@contextmanager
def state_settings(spark):
    """Session settings a query takes over when it starts: the store that keyed state needs, and no batches without data, which state
    that expires would ask for without end (nothing comes out of an expiry)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_repeat_gaps(stream: DataFrame, forget_after: int = FORGET_AFTER) -> DataFrame:
    """Repeat gaps per run kept as keyed state (run_id, pos, kx in arrival order of batches).

    A row whose position the run has passed in an earlier batch is late: it comes out with NULL event and gap, and changes nothing. A key
    that has expired counts as new. The state needs the session's RocksDB store, which this sets.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.select("run_id", "pos", "kx").groupBy("run_id").transformWithStateInPandas(
        RepeatGaps(forget_after), GAP_SCHEMA, "Append", "ProcessingTime")
