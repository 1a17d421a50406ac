from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.streaming import watches


def plain(readings, rounds, idle):
    """Watches that end by a reading, or before one, key by key."""
    out = []
    for key in sorted({r[0] for r in readings}):
        watch, own = 0, []
        for _, at, _, value in sorted((r for r in readings if r[0] == key), key=lambda r: r[1:3]):
            if own and at - own[-1][0] > idle:
                out.append((key, watch, len(own), own[-1][1], "idle", own[0][0], own[-1][0] + idle))
                watch, own = watch + 1, []
            equal = bool(own) and value is not None and own[-1][1] == value
            own.append((at, value))
            if equal or len(own) >= rounds:
                out.append((key, watch, len(own), value, "equal" if equal else "rounds", own[0][0], at))
                watch, own = watch + 1, []
    return out


def test_watches_go_on_from_their_checkpoint(spark, tmp_path):
    """Two runs over files that arrive in turn give what one pass over all readings gives; an idle key is ended by its timer."""
    begin, idle = datetime(2026, 1, 1), timedelta(hours=2)
    readings = [(f"k{k % 7}", begin + timedelta(minutes=3 * k + k % 5), k, [None, "a", "b", "b", "c", "d"][k * k % 11 % 6]) for k in range(400)]
    readings += [("quiet", begin + timedelta(minutes=5), 1000, "x"), ("quiet", begin + timedelta(hours=9), 1001, "x"), ("last", begin + timedelta(hours=10), 1002, "y")]
    readings.sort(key=lambda r: r[1])
    session = watches.session_for_state(spark)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "key string, at timestamp, tie long, value string"

    def run(rows):
        for k in range(0, len(rows), 50):
            session.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = watches.settled(stream, 5, "2 hours", "1 minute").writeStream.trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out)
        query.awaitTermination()

    run(readings[:200])
    some = session.read.schema(watches.WATCHES).parquet(out).count()
    run(readings[200:])
    got = [tuple(r) for r in session.read.schema(watches.WATCHES).parquet(out).collect()]
    timed = [r for r in got if r[0] == "last"]
    assert 0 < some < len(got)
    assert timed == [("last", 0, 1, "y", "idle", begin + timedelta(hours=10), begin + timedelta(hours=12))]
    ends = {r[0] for r in got if r[4] == "idle"}
    expected = plain(readings, 5, idle)
    assert "quiet" in ends and set(expected) <= set(got) and len(got) == len(set(got))
    assert all(r[4] == "idle" for r in set(got) - set(expected))  # beyond those, keys that no reading followed
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != watches.ROCKSDB


def test_null_readings_are_equal_to_none(spark, tmp_path):
    rows = [("k", datetime(2026, 1, 1, 0, m), m, None) for m in range(3)]
    session = watches.session_for_state(spark)
    session.createDataFrame(rows, "key string, at timestamp, tie long, value string").write.parquet(str(tmp_path / "in"))
    stream = session.readStream.schema("key string, at timestamp, tie long, value string").parquet(str(tmp_path / "in"))
    query = watches.settled(stream, 3).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    assert [(r["rounds"], r["why"]) for r in session.read.schema(watches.WATCHES).parquet(str(tmp_path / "out")).select(F.col("rounds"), "why").collect()] == [(3, "rounds")]


def test_files_of_a_time_make_one_batch_and_idle_ends_wait_a_second(spark, tmp_path):
    """A batch never mixes parts of days, whose later rows would be late, however many files they have; an idle end is told as the SQL tells it."""
    import duckdb

    from pagemill.plans import catalogue

    day, end = datetime(2024, 1, 1), datetime(2024, 1, 29)
    events = [(k, day + timedelta(seconds=(k * 4999 % 2400) * 1000), k % 50, "abc"[k * k % 3]) for k in range(2400)]
    events += [(9000 + k, end - timedelta(hours=25) - timedelta(milliseconds=s), 900 + k, "x") for k, s in enumerate((-500, 500, 900, 1100, 5000))]
    events += [(9999, end, 999, "x")]
    frame = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    # three files, of which one lacks some of the parts of days
    frame.where("event_id % 3 = 0 AND ts < timestamp_ntz'2024-01-12'").unionByName(frame.where("event_id % 3 <> 0 OR ts >= timestamp_ntz'2024-01-12'").repartition(2, "event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.settled_events(spark, str(tmp_path)).toPandas().astype(str)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(catalogue.SQL["settled_events"]).df()[list(got.columns)].astype(str)
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, wanted.values))
