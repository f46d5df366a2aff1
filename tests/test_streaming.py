"""The state functions, batch by batch, with a stand-in for Spark's group state."""

import datetime as dt

import pandas as pd

from plumbline.streaming import state


class State:
    hasTimedOut = False

    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        pass


def frame(rows):
    return pd.DataFrame([(dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s), i, f) for s, i, f in rows], columns=["ts", "event_id", "fingerprint"])


def run(f, own, rows):
    return pd.concat(list(f(("k",), iter([frame(rows)]), own)))


def test_changes_keep_only_the_last_fingerprint():
    own = State()
    assert run(state._changes, own, [(0, 0, "A"), (1, 1, "A"), (2, 2, "B")]).event_id.tolist() == [0, 2]
    assert run(state._changes, own, [(3, 3, "B"), (4, 4, "A")]).event_id.tolist() == [4]


def test_limits_are_anchored_at_the_first_request():
    own, f = State(), state.limiter(limit=2, window_s=60)
    assert run(f, own, [(0, 0, ""), (1, 1, ""), (59, 2, "")]).allowed.tolist() == [True, True, False]
    assert run(f, own, [(60, 3, ""), (61, 4, ""), (62, 5, "")]).allowed.tolist() == [True, True, False]
    own.hasTimedOut = True
    assert not list(f(("k",), iter([]), own)) and own.value is None


def streamed(spark, tmp_path, rows, schema, work):
    """What ``work`` makes of rows that arrive one file after the other; the query ends by itself, or after a minute."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path))) % 10**8}"
    query = work(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
        return spark.table(name).collect()
    finally:
        query.stop()


def test_changes_as_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [[("k", at(0), 0, "A"), ("k", at(1), 1, "A")], [("k", at(2), 2, "A"), ("m", at(2), 3, "B")], [("k", at(3), 4, "C")]]
    got = streamed(spark, tmp_path, rows, "session string, ts timestamp, event_id long, fingerprint string", state.changed)
    assert sorted(r.event_id for r in got) == [0, 3, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [[("k", at(0), 0, ""), ("k", at(7200), 1, "")], [("k", at(9000), 2, "")], [("k", at(10), 3, "")], [("k", at(20000), 4, "")]]
    work = lambda s: state.windowed_counts(s, "ts", "session", "10 minutes", "30 minutes")
    got = streamed(spark, tmp_path, rows, "session string, ts timestamp, event_id long, fingerprint string", work)
    assert {(r.start, r.n) for r in got} == {(at(0), 1), (at(7200), 1), (at(9000), 1)}


def test_contributions_read_before_they_write(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([("a", 0)], "asin string, n long").write.parquet(path)
    seen = []

    def step(batch, number):
        known = spark.read.parquet(path)
        seen.append((number, known.count()))
        batch.select("asin", F.lit(number).cast("long").alias("n")).write.mode("append").parquet(path)

    for k in range(2):
        spark.createDataFrame([("b",)], "asin string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("asin string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = state.contribute(stream, step, str(tmp_path / "state"), available_now=True)
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    assert seen == [(0, 1), (1, 2)] and spark.read.parquet(path).count() == 3
