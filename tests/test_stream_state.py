"""Keyed state of the repeat gaps over several micro-batches: equal to the batch operator, late rows, keys that expire."""
import random

import pandas as pd

from ionweave.operators import acquisition
from ionweave.streaming import streams

SCHEMA = "run_id long, pos long, kx long"


class Feed:
    """A folder of arriving files, each run of the query taking what is new."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, path, 0

    def run(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.path}/in/{self.files}")
        self.files += 1
        out = []
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}/in")
        with streams.state_settings(self.spark):
            q = (streams.stream_repeat_gaps(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect())))
                 .option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start())
            q.awaitTermination()
        return sorted(out, key=repr)


def test_micro_batches_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(51)
    rows = [(run, pos, rng.choice([5, 5, 7, 260, 900, 901]) if run else pos % 3) for run in range(3) for pos in range(60)]
    feed, got = Feed(spark, tmp_path), []
    for a, z in ((0, 25), (25, 26), (26, 60)):
        part = [r for r in rows if a <= r[1] < z]
        rng.shuffle(part)
        got += feed.run(part)
    s = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", klo long, kup long")
    want = acquisition.repeat_gaps(acquisition.collapse_events(s)).select("run_id", "kx", "event", "gap")
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_late_rows_change_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.run([(1, 10, 5), (1, 20, 7), (1, 30, 5)]) == [(1, 5, 3, 2)]
    assert feed.run([(1, 25, 7), (1, 30, 9), (1, 40, 7), (2, 1, 4)]) == sorted([(1, 7, None, None), (1, 9, None, None), (1, 7, 4, 2)], key=repr)


class Held:
    """A state variable in memory."""

    def __init__(self):
        self.rows = {}

    def exists(self):
        return () in self.rows

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_keys_expire():
    state = streams.RepeatGaps(forget_after=1000)
    state.run, state.seen = Held(), Held()

    def batch(now, *rows):
        frame = pd.DataFrame(rows, columns=["pos", "kx"])
        return [tuple(r) for part in state.handleInputRows((1,), iter([frame]), Clock(now)) for r in part.itertuples(index=False)]

    assert batch(0, (1, 5), (2, 300), (3, 5)) == [(1, 5, 3, 2)]
    assert batch(900, (4, 300)) == [(1, 300, 4, 2)]
    # key 5 was last selected 1,500 ms ago, key 300 600
    assert batch(1500, (5, 5), (6, 300)) == [(1, 300, 6, 2)]
    assert batch(3000, (7, 9)) == [] and set(state.seen.rows[(0,)][0]) == {9}
