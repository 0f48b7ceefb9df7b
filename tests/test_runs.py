from waymill.operators import rooms, runs, stations

RAW = "raw_id long, mgmt_no string, biz_name string, biz_type_name string, road_address string, jibun_address string, phone string, biz_status_name string, license_date string, closed_date string, coord_x string, coord_y string"


def register(spark, *rows):
    return lambda: spark.createDataFrame([(i, k, n, "한식", "road", f"lot {k}", "02", s, "20200101", None, x, "450000.0") for i, (k, n, s, x) in enumerate(rows)], RAW)


def test_runs_skip_fail_and_merge(spark, tmp_path):
    folder, on, off = str(tmp_path / "reg"), "영업/정상", "폐업"
    first = register(spark, ("A", "a", on, "200000.0"), ("B", "b", on, "200100.0"), ("C", "c", on, None), ("D", "d", off, "200200.0"))
    second = register(spark, ("A", "a2", on, "200000.0"), ("B", "b", off, "200100.0"), ("E", "e", on, "200300.0"))

    def broken():
        raise OSError("no such file")

    assert runs.served(spark, folder, "FOOD") is None
    runs.run_all(spark, folder, [runs.Input("FOOD", "h1", first), runs.Input("REST", "x", broken)])
    runs.run_all(spark, folder, [runs.Input("FOOD", "h1", broken), runs.Input("REST", "x", first)])
    got = runs.run_all(spark, folder, [runs.Input("FOOD", "h2", second), runs.Input("REST", "y", broken)]).orderBy("id").collect()
    assert [(r.id, r.source, r.status) for r in got] == [(1, "FOOD", "SUCCESS"), (2, "REST", "FAILED"), (3, "FOOD", "SKIPPED"), (4, "REST", "SUCCESS"), (5, "FOOD", "SUCCESS"), (6, "REST", "FAILED")]
    assert (got[0].rows_raw, got[0].rows_valid, got[0].n_new) == (4, 3, 4) and got[2].rows_raw == 0 and "no such file" in got[5].message
    assert (got[4].n_new, got[4].n_kept, got[4].n_vanished, got[4].n_closed) == (1, 2, 2, 1)
    food = {r.source_id: (r.name, r.status, r.first_seen, r.last_seen) for r in runs.served(spark, folder, "FOOD").collect()}
    assert food == {"A": ("a2", "ACTIVE", 1, 5), "B": ("b", "CLOSED", 1, 5), "D": ("d", "CLOSED", 1, 1), "E": ("e", "ACTIVE", 5, 5)}
    assert runs.served(spark, folder, "REST").count() == 3


def test_station_lookup(spark):
    master = spark.createDataFrame([("2", "강남", 1.0, 1.0, 1), ("1", "부평", 2.0, 2.0, 2), ("4", "불암산", 3.0, 3.0, 3), (None, "회기", 4.0, 4.0, 4), ("2", "강남(x)", 9.0, 9.0, 5)], "line string, station string, lat double, lon double, place int")
    wanted = spark.createDataFrame([("2", "강남"), ("1", "부평"), ("4", "당고개"), ("1", "회기"), ("2", "없는역"), ("9급행", "강남")], "line string, station string")
    renamed = spark.createDataFrame([("4", "당고개", "불암산")], "line string, station string, other string")
    found, missing = stations.located(wanted, master, renamed)
    assert {(r.line, r.station): r.lat for r in found.collect()} == {("2", "강남"): 1.0, ("1", "부평"): 2.0, ("4", "당고개"): 3.0, ("1", "회기"): 4.0, ("9급행", "강남"): 1.0}
    assert [tuple(r) for r in missing.collect()] == [("2", "없는역")]


def test_resnapped(spark):
    members = spark.createDataFrame([(1, 1, 0.0, 0.0, 5, 1.0, 1), (1, 2, 0.0, 0.0, 5, 1.0, 2), (1, 3, 90000.0, 0.0, 5, 1.0, None), (1, 4, None, None, None, None, None)], "room_id long, user_id long, x double, y double, origin_node_id long, origin_snap_m double, origin_build_id int")
    nodes = spark.createDataFrame([(8, 3.0, 4.0), (9, 30.0, 4.0)], "id long, x double, y double")
    got = {r.user_id: (r.origin_node_id, r.origin_snap_m, r.origin_build_id) for r in rooms.resnapped(members, nodes, 2).collect()}
    assert got == {1: (8, 5.0, 2), 2: (5, 1.0, 2), 3: (None, None, 2), 4: (None, None, None)}
