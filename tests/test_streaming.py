import datetime as dt

from waymill.operators.rooms import limited
from waymill.streaming.limits import capped_stream, drained, ingest_drops, limited_stream

REQUEST = "key string, ts timestamp, id long, uncounted boolean"


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def played(spark, tmp_path, batches, schema, transform):
    """Files dropped and drained one batch after the other by one checkpoint."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(inbox)
        drained(spark, transform, df.schema, inbox, out, str(tmp_path / "checkpoint"))
    return spark.read.parquet(out)


def test_rate_limiter_over_batches(spark, tmp_path):
    day = 86_400
    batches = [
        [("a", at(0), 0, False), ("a", at(20), 2, False), ("a", at(10), 1, False), ("b", at(5), 5, True), ("b", at(6), 6, False)],
        [("b", at(7), 7, False), ("b", at(8), 8, False), ("a", at(65), 3, False), ("c", None, 9, False)],
        [("z", at(3 * day), 10, False)],
        [("a", at(3 * day), 11, False), ("a", at(3 * day + 1), 12, False), ("a", at(3 * day + 2), 13, False)],
    ]
    got = {r.id: r.allowed for r in played(spark, tmp_path, batches, REQUEST, lambda s: limited_stream(s, 2, 60)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 5: True, 6: True, 7: True, 8: False, 10: True, 11: True, 12: True, 13: False}


def test_rate_limiter_equals_its_batch_twin(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = sorted((at(rng.randrange(4000)), rng.choice("abc"), i, rng.random() < 0.2) for i in range(300))
    rows = [(k, t, i, u) for t, k, i, u in rows]
    rows.sort(key=lambda r: (r[1], r[2]))
    batches = [rows[i : i + 77] for i in range(0, 300, 77)]
    got = {r.id: r.allowed for r in played(spark, tmp_path, batches, REQUEST, lambda s: limited_stream(s, 3, 500)).collect()}
    whole = spark.createDataFrame(rows, REQUEST).select("key", "ts", "id", "uncounted")
    assert got == {r.id: r.allowed for r in limited(whole, "key", "ts", 3, 500).collect()}


def test_rate_limits_equal_their_sql_at_parts_of_seconds(spark, tmp_path):
    """Windows begin and end at the nearest second, of two the even one, as the SQL's cast has it."""
    import duckdb

    from waymill.plans import rooms

    at_ = lambda day, s: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=s)
    # A window that begins at 0.6 or 1.5 s ends at 1 or 2 s of the next day, one from 0.5 s at 0.
    times = {0: [0.6, 0.7, 0.8], 1: [1.5, 1.6, 1.7], 2: [0.5, 0.6, 0.7], 3: [0.2, 0.9, 3.5]}
    rows = [(u, at_(0, s)) for u, t in times.items() for s in t] + [(u, at_(1, s)) for u in times for s in (0.2, 0.5, 1.2, 1.8)]
    rows = [(i, u, t, "click", 1.0) for i, (u, t) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(rooms.SQL["rate_limit_fixed_window"]).fetchall())
    assert sorted(map(tuple, rooms.rate_limit_fixed_window(spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, rooms.rate_limit_stream(spark, str(tmp_path)).collect())) == want


def test_daily_cap_over_batches(spark, tmp_path):
    hour = 3600
    batches = [[(1, at(20 * hour)), (2, at(21 * hour))], [(4, at(23 * hour)), (3, at(22 * hour)), (5, at(40 * hour)), (6, None)], [(7, at(200 * hour))], [(8, at(200 * hour))]]
    got = {r.id: (r.local_day, r.kept) for r in played(spark, tmp_path, batches, "id long, ts timestamp", lambda s: capped_stream(s, 3)).collect()}
    assert got == {1: ("2024-01-02", True), 2: ("2024-01-02", True), 3: ("2024-01-02", True), 4: ("2024-01-02", False), 5: ("2024-01-03", True), 7: ("2024-01-09", True), 8: ("2024-01-09", True)}


def test_dropped_files_are_processed_once(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    seen = []
    schema = spark.createDataFrame([], "a string, b string").schema
    for text in ("a,b\n1,x\n", "a,b\n2,y\n3,z\n"):
        (folder / f"{len(seen)}.csv").write_text(text)
        ingest_drops(spark, str(folder), schema, lambda df, _: seen.append(sorted(r.a for r in df.collect())), str(tmp_path / "ledger")).awaitTermination()
    assert seen == [["1"], ["2", "3"]]
