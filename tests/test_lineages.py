import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.streaming.lineages import live_counts, live_lineages

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "user string, event long, at timestamp, change long"


@pytest.fixture
def replay(spark, tmp_path):
    """Runs a stream over tables, one batch each, and returns its rows."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(tables, name, **options):
        for k, t in enumerate(tables):
            t.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = live_lineages(stream, *tables[0].columns, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert query.awaitTermination(300) and query.exception() is None
        return sorted(map(tuple, spark.table(name).collect()), key=lambda r: (r[0], r[2], -1 if r[1] is None else r[1]))

    yield run
    spark.conf.set(PROVIDER, before)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def table(spark, rows):
    return spark.createDataFrame([(u, e, None if m is None else at(m), c) for u, e, m, c in rows], SCHEMA)


def test_late_repeated_expired(spark, replay):
    batches = [
        [("a", 1, 10, 1), ("a", 2, 5, 1), ("b", 3, 7, 1), ("b", 3, 7, 1), ("a", None, 6, 1), ("c", 20, None, 1)],
        [("a", 1, 10, 1), ("a", 4, 12, -1), ("z", 9, 60, 1)],  # a repeated row; the watermark goes to 40
        [("a", 8, 9, 1), ("a", 1, 10, 1), ("b", 6, 70, -1), ("z", 10, 70, 0)],  # nothing is counted yet, so none of these is late
        [("a", 5, 8, 1), ("a", 1, 10, 1), ("a", 7, 75, -1), ("z", 11, 400, 0)],  # late, repeated and late, on time
        [("z", 12, 500, 0)],
    ]
    found = replay([table(spark, b) for b in batches], "lineages_hard", late="20 minutes", idle_seconds=6000)
    assert [r for r in found if r[0] != "z"] == [
        ("a", 2, at(5), 1, False), ("a", 8, at(9), 2, False), ("a", 1, at(10), 3, False), ("a", 4, at(12), 2, False), ("a", 7, at(75), 1, False), ("a", None, at(175), 0, True),
        ("b", 3, at(7), 1, False), ("b", 6, at(70), 0, False),
    ]
    assert [r for r in found if r[0] == "z"] == [("z", 9, at(60), 1, False), ("z", 10, at(70), 1, False), ("z", None, at(170), 0, True), ("z", 11, at(400), 0, False)]


def test_events_replayed(spark, replay):
    """The events table in four batches, each with the whole axis shuffled into it, equals the running sums of the table."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("long").alias("event"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("value") > 50, 1).otherwise(-1).cast("long").alias("change"))
    parts = [events.where(f"event % 4 = {k}") for k in range(4)]
    parts.append(spark.createDataFrame([("nobody", -1, datetime.datetime(2100, 1, 1), 1)], SCHEMA))
    found = replay(parts, "lineages_all", late="3650 days")
    want = live_counts(events, "user", "event", "at", "change").select("*", F.lit(False)).collect()
    assert found == sorted(map(tuple, want), key=lambda r: (r[0], r[2], r[1])) and len(found) == events.count()
