"""Cases with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions import scalars as s
from waymill.operators import graph, ingest, routes, rules, search, timing, transfers
from waymill.operators import rooms as rooms_op
from waymill.operators.spatial import clamped, nearest_any
from waymill.sources import readers


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parsers(spark):
    day = dt.date(2019, 3, 7)
    good = ["2019-03-07", "20190307", "2019-3-7", "2019-3-07 23:59:60", "\t2019-03-07 ", "2019-3-7 5:06:07", "20190307170000"]
    assert column(spark, good, s.parse_date) == [day] * len(good)
    assert column(spark, ["", "   ", "미상", "2019-02-30", "2019-3-7 5:06", "19-03-07", None], s.parse_date) == [None] * 7
    assert column(spark, ["00:00:07", "03:04:05", "24:00:09", "26:10:30", "00:00:00", "7:15", "xx:10:00", " ", None], s.parse_hms) == [7, 11045, 86409, 94230] + [None] * 5
    assert column(spark, ["영업/정상", "영업", " 영업/정상 ", "폐업", "휴업", None], s.is_active) == [True] * 3 + [False] * 3
    assert column(spark, [" 한식 · 분식 ", " · ", None], s.normalize_category) == ["한식분식", None, None]
    assert column(spark, ["2호선", " 9 호선 ", "경인선", "12호선"], s.normalize_line) == ["2", "9", None, None]
    assert column(spark, ["이수(7)", "강남 역", "서울역"], s.station_key) == ["총신대입구", "강남역", "서울역"]
    assert column(spark, ["oil-u23k", "ABCD-EFGH", "short"], s.invite_code) == [None, "ABCDEFGH", None]
    assert column(spark, ["127.1, 37.5", "강남역", "1,2,3"], s.coordinate) == [(127.1, 37.5), None, None]


def test_line_keys(spark):
    rows = [("9", "1", "a", "b"), ("2", "0", "성수", "신설동"), ("2", "0", "신설동", "시청"), ("2", "0", "까치산", "양천구청"), ("2", "0", "x", "도림천"), ("2", "0", "성수", "성수"), ("1", "0", "신설동", "인천"), ("1", None, "a", "b"), ("2", "0", "신설동", "까치산"), ("2", "0", None, None)]
    df = spark.createDataFrame(rows, "l string, e string, a string, b string")
    keys = [r.k for r in df.select(s.line_key(F.col("l"), F.col("e"), F.col("a"), F.col("b")).alias("k")).collect()]
    assert keys == ["9급행", "2성수지선", "2성수지선", "2신정지선", "2신정지선", "2", "1", "1급행", "2성수지선", "2"]
    assert column(spark, ["9급행", "2성수지선", "경의선"], s.line_name) == ["9호선 급행", "2호선 성수지선", "경의선"]


def test_sign_up(spark):
    assert column(spark, ["Mina_7", " mina_7", "mina_7\n", "abc", "a" * 21, "민아아아", None], s.login_id) == ["mina_7", None, None, None, None, None, None]
    assert column(spark, [" 민아 ", "a", "  ", "x" * 20, "x" * 21, "🙂" * 11, "🙂" * 10, " a", None], s.nickname) == ["민아", None, None, "x" * 20, None, None, "🙂" * 10, "a", None]
    assert column(spark, ["12345678", "1234567", " " * 9, None], lambda c: s.password_fits(c, c)) == [True, False, False, False]
    names = ['attachment; filename="a b.csv"', "x; filename*=UTF-8''%EA%B0%80+.csv; filename=b", "inline", None]
    assert column(spark, names, s.attachment_name) == ["a b.csv", "가+.csv", None, None]


def test_hours(spark):
    assert column(spark, [[-1, 100, 124], [-1, -1], [5], []], s.representative, "array<int>") == [112, -1, 5, -1]
    assert column(spark, [[-1, 10]], lambda c: s.shifted_hours(c, F.lit(5)), "array<int>") == [[-1, 15]]
    assert column(spark, [2.5, 3.5, 0.2], s.walk_seconds, "double") == [2, 3, 1]


STOP = "id int, line string, direction string, train string, station string, arrive int, depart int"


def test_leg_times_and_headways(spark):
    h = 19 * 3600
    rows = [(1, "2", "UP", "T1", "강남", h, h + 30), (2, "2", "UP", "T1", "역삼", h + 120, h + 150), (3, "2", "UP", "T1", "선릉", h + 240, h + 270), (4, "2", "DOWN", "T1", "강남", h + 500, h + 530)]
    legs = {(r.a, r.b): r.seconds for r in timing.leg_times(spark.createDataFrame(rows, STOP)).collect()}
    assert legs == {("강남", "역삼"): 120, ("역삼", "선릉"): 120}
    trains = [(i, "2", "UP", f"T{i}", "강남", 8 * 3600 + 240 * i, 0) for i in range(5)] + [(9, "2", "UP", "X", "강남", 24 * 3600 + 1200, 0), (10, "2", "UP", "Y", "강남", 24 * 3600 + 1800, 0)]
    got = {r.hour: r.seconds for r in timing.headways(spark.createDataFrame(trains, STOP)).collect()}
    assert got == {8: 240, 0: 600}


def test_board_weights_fill_service_hours(spark):
    gaps = spark.createDataFrame([("2", "a", 7, 240.0)], "line string, station string, hour int, seconds double")
    service = spark.createDataFrame([("2", "a", [5, 6, 7, 8]), ("2", "b", [5])], "line string, station string, hours array<int>")
    rows = timing.board_weights(gaps, service).collect()
    assert [(r.station, r.by_hour) for r in rows] == [("a", [120 if 5 <= i <= 8 else -1 for i in range(24)])]


def test_section_hours(spark):
    rows = [("r", "95", "0", "0"), ("r", "124", "0", "90"), ("r", "128", "0", "95"), ("r", "134", "80", "100"), ("r", "135", "81", "x"), ("once", "500", "4000", "0")]
    df = spark.createDataFrame(rows, "k string, a string, b string, c string")
    out = {r.k: r.by_hour for r in timing.section_hours(df, ["k"], ["a", "b", "c"], 5).collect()}
    assert out == {"r": [128, -1, 95], "once": [-1, -1, -1]}
    assert timing.section_hours(df.where("k = 'once'"), ["k"], ["a", "b", "c"], 1).first().by_hour == [500, 4000, -1]


def test_reference_check(spark):
    rows = [("1", "시청", 8, 200.0), ("1", "인천", 8, 900.0), ("1", "시청", 9, 9000.0), ("4", "오이도", 8, 310.0), ("2", "강남", 8, 60.0), ("3", "x", 8, 361.0), ("9급행", "x", 8, 9000.0), ("경의", "x", 8, 9000.0)]
    got = {r.line: tuple(r)[1:] for r in timing.reference_check(spark.createDataFrame(rows, "line string, station string, hour int, seconds double")).collect()}
    assert got == {"1": (3.3, 3.0, 1.11, True, True), "4": (5.2, 2.5, 2.07, True, False), "2": (1.0, 2.5, 0.4, False, True), "3": (6.0, 3.0, 2.01, False, False), "경의": (150.0, None, None, False, True)}


PAIR = "station string, line_a string, line_b string, sec int"


def test_calibration(spark):
    measured = spark.createDataFrame([("p", "1", "2", 250), ("q", "2", "7", 0), ("r", "3", "4", 130)], PAIR)
    distance = spark.createDataFrame([("p", "1", "2", 150), ("q", "2", "7", 30), ("r", "3", "4", 20), ("s", "2", "9", 60), ("t", "2", "9", 2)], PAIR)
    assert tuple(transfers.offset(measured, distance).first()) == (100, 3)
    got = {r.station: (r.sec, r.source) for r in transfers.calibrated(measured, distance).collect()}
    assert got == {"p": (250, "MEASURED"), "q": (1, "MEASURED"), "r": (130, "MEASURED"), "s": (160, "CALIBRATED"), "t": (102, "CALIBRATED")}
    with pytest.raises(ValueError, match="no pair in common"):
        transfers.calibrated(measured, distance.where("station = 's'"))


def test_raised_walks(spark):
    import random

    rng = random.Random(6)
    pairs = [(f"s{i}", a, b, rng.randrange(20, 400), f"{k:02d}") for i in range(12) for k, (a, b) in enumerate((a, b) for a in "1234"[: 2 + i % 3] for b in "1234"[: 2 + i % 3] if a != b)]
    t = spark.createDataFrame(pairs, PAIR + ", ord string")
    walks = spark.createDataFrame([(f"s{i}", 40 + i) for i in range(11)], "station string, sec int")
    median = sorted(p[3] for p in pairs)
    middle = (median[(len(median) - 1) // 2] + median[len(median) // 2]) / 2
    other = max(1, round(middle / 2))
    want = {}
    for i in range(12):
        mine = {x: 40 + i if i < 11 else other for p in pairs if p[0] == f"s{i}" for x in p[1:3]}
        settled = False
        while not settled:
            settled = True
            for _, a, b, need, _ in (p for p in pairs if p[0] == f"s{i}"):
                if mine[a] + mine[b] <= need:
                    gap = need - mine[a] - mine[b] + 1
                    mine[a], mine[b], settled = mine[a] + gap - gap // 2, mine[b] + gap // 2, False
        want |= {(f"s{i}", x): v for x, v in mine.items()}
    assert {(r.station, r.line): r.sec for r in transfers.raised(t, walks).collect()} == want
    platforms = spark.createDataFrame([("s0", "1급행"), ("s0", "9"), ("far", "1")], "station string, line string")
    got = {(r.station, r.line): r.sec for r in transfers.platform_walks(platforms, t).collect()}
    assert got["far", "1"] == other and set(got) == {("s0", "1급행"), ("s0", "9"), ("far", "1")}


def test_transfer_files(spark):
    raw = spark.createDataFrame([(" 1", "4호선", "서울역(1)", "01:30", 0), ("4", "1호선", "서울역", "09:00", 1), ("1", "4호선", "서울역", "05:00", 2), ("2", "공항철도", "홍대", "02:00", 3), ("2", "2호선", "x", "01:00", 4), ("7", "4호선", "이수", "bad", 5)], "`호선` string, `환승노선` string, `환승역명` string, `환승소요시간` string, ord int")
    got = {tuple(r) for r in transfers.from_distance(raw).collect()}
    assert got == {("서울역", "1", "4", 90), ("서울역", "4", "1", 540)}
    rows = [("4", "7", "총신대입구", "이수", "02:50"), ("4", "7", "총신대입구(이수)", "이수", "03:00"), ("4", "7", "이수", "이수", "10:00"), ("1", "신림", "a", "a", "01:00"), ("1", "2", "a", "b", "01:00"), ("1", "1", "a", "a", "01:00")]
    raw = spark.createDataFrame(rows, "`환승시작 호선` string, `환승종료 호선` string, `환승시작역` string, `환승종료역` string, `소요시간` string")
    assert [tuple(r) for r in transfers.from_measurements(raw).collect()] == [("총신대입구", "4", "7", 175)]


RUN = "source_id string, biz_status_name string"


def test_run_diff(spark):
    a, x = "영업/정상", "폐업"
    prev = spark.createDataFrame([("k1", x), ("k2", a), ("k3", a), ("k5", None), ("k6", a)], RUN)
    cur = spark.createDataFrame([("k1", a), ("k2", x), ("k3", None), ("k4", x), ("k5", x), ("k7", a)], RUN)
    active = F.col("biz_status_name").isin(*s.ACTIVE_STATES)
    assert tuple(ingest.run_diff(prev, cur, active).first()) == (2, 4, 1, 1)
    assert tuple(ingest.run_diff(None, cur, active).first()) == (6, 0, 0, 0)


def test_retention_counts_runs_with_data(spark):
    rows = spark.createDataFrame([("A", r) for r in (1, 2, 5, 8, 9)], "source string, run_id int")
    assert sorted(r.run_id for r in ingest.expired_runs(rows, 2).collect()) == [1, 2, 5]
    assert ingest.expired_runs(rows.where("run_id > 5"), 2).count() == 0


def raw(spark, rows):
    schema = T.StructType([T.StructField("raw_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("mgmt_no", "biz_name", "biz_type_name", "road_address", "jibun_address", "phone", "biz_status_name", "license_date", "closed_date", "coord_x", "coord_y")]])
    return spark.createDataFrame(rows, schema)


def test_staging(spark):
    rows = [(0, " A-1 ", "첫번째", "한식", None, "lot", None, "영업/정상", "20200101", None, "200000.0", "450000.0"), (1, "B-2", "다른가게", None, None, None, None, "폐업", "없음", "2021-02-03", None, ""), (2, "  ", "x", *[None] * 9), (3, "A-1", " 마지막 ", "한식", None, "lot", None, "영업/정상", "20200101", None, "200000.0", "450000.0")]
    typed, gauge = ingest.staging(raw(spark, rows))
    got = {r.source_id: r for r in typed.collect()}
    assert set(got) == {"A-1", "B-2"} and got["A-1"].name == "마지막" and got["A-1"].x_5186 == pytest.approx(200_070, abs=80)
    assert got["B-2"].x_5186 is None and got["B-2"].licensed_date is None and got["B-2"].closed_date == dt.date(2021, 2, 3)
    assert tuple(gauge.first())[:2] == (2, 0)


def test_rules_and_validity(spark):
    df = spark.createDataFrame([("1", "n", "l", "영업", None, None, 1.0, 1.0), ("2", " ", "l", None, None, None, 1.0, 1.0), ("3", "n", "l", "폐업", None, None, None, None)], "source_id string, name string, jibun_address string, biz_status_name string, licensed_date date, closed_date date, x_5186 double, y_5186 double")
    found = rules.findings(df, df.withColumn("x_5186", F.col("x_5186") + 20))
    codes = sorted((r.rule_code, r.target_id) for r in found.collect())
    assert codes == [("COORD_MISSING", "3"), ("COORD_MOVED", "1"), ("COORD_MOVED", "2"), ("DUPLICATE_NAME_ADDR", "1"), ("DUPLICATE_NAME_ADDR", "3"), ("NAME_MISSING", "2"), ("STATUS_DATE_CONFLICT", "3")]
    assert {r.source_id: r.is_valid for r in rules.apply(df, found).collect()} == {"1": True, "2": False, "3": False}


def edges(spark, rows):
    return spark.createDataFrame([(a, b, w, h) for a, b, w, *r in rows for h in [r[0] if r else None]], "src long, dst long, weight_sec int, by_hour array<short>")


def origin(spark, node, hour=None):
    return spark.createDataFrame([(node, hour)], "origin long, hour int")


def test_search(spark):
    detour = edges(spark, [(1, 2, 100), (1, 3, 10), (3, 2, 10)])
    r = search.one_to_many(detour, origin(spark, 1), [2], paths_too=True).first()
    assert r.seconds == 20 and [(p.node, p.seconds) for p in r.path] == [(3, 10), (2, 20)]
    r = search.one_to_many(detour, origin(spark, 1), [1], paths_too=True).first()
    assert r.seconds == 0 and r.path == []
    chain = edges(spark, [(i, i + 1, 1) for i in range(100)])
    settled = lambda t: search.one_to_many(chain, origin(spark, 0), t).first().settled
    assert settled([3]) < settled([99]) and settled([49]) == settled([5, 15, 49])
    busy = [10] * 24
    busy[19] = 500
    e = edges(spark, [(1, 2, 10, busy)])
    assert [search.one_to_many(e, origin(spark, 1, h), [2]).first().seconds for h in (8, 19, None)] == [10, 500, 10]
    night = [-1] * 24
    night[2] = 10
    e = edges(spark, [(1, 2, 10, night), (1, 3, 100), (3, 2, 100)])
    assert [search.one_to_many(e, origin(spark, 1, h), [2]).first().seconds for h in (2, 19)] == [10, 200]
    assert search.one_to_many(edges(spark, [(1, 2, 10, night)]), origin(spark, 1, 3), [2]).count() == 0
    assert search.one_to_many(detour, origin(spark, 99), [2]).count() == 0


def plain(rows, source, targets, hour):
    """Dijkstra by a heap over labels (seconds, edges): (seconds by node, paths, nodes settled)."""
    import heapq

    best, heap, before = {}, [((0, 0), source)], {}
    out = {}
    for a, b, w, h in rows:
        w = w if hour is None or h is None else h[hour]
        if w >= 0:
            out.setdefault(a, []).append((b, w))
    while heap:
        label, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = label
        for v, w in out.get(u, []):
            heapq.heappush(heap, ((label[0] + w, label[1] + 1), v))
    for u in sorted(best):
        for v, w in out.get(u, []):
            if best[v] == (best[u][0] + w, best[u][1] + 1) and v not in before:
                before[v] = u
    paths = {}
    for v in best:
        paths[v] = [v]
        while paths[v][-1] != source:
            paths[v].append(before[paths[v][-1]])
    hit = [best[t][0] for t in targets if t in best]
    whole = len(hit) < len(targets)
    settled = len(best) if whole else sum(d[0] <= max(hit) for d in best.values())
    return {v: d[0] for v, d in best.items()}, {v: p[-2::-1] for v, p in paths.items()}, settled


@pytest.mark.parametrize("way", ["kernel", "parts", "parts by place", "joins"])
def test_searches_equal_plain_ones(spark, monkeypatch, way):
    import random

    from waymill.operators import parts

    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9), None if i % 3 else [rng.choice([-1, rng.randrange(1, 9)]) for _ in range(24)]) for i in range(200)]
    asked = [(0, 5, [3, 9, 41]), (7, None, [12]), (7, 5, [7, 1000]), (59, 23, None), (999, 5, [1])]
    origins = spark.createDataFrame(asked + asked[:1], "origin long, hour int, targets array<long>")
    graph_ = edges(spark, rows)
    if way != "kernel":
        monkeypatch.setattr(search, "BROADCAST_EDGES", 10)
        monkeypatch.setattr(parts.divided, "__defaults__", (None, 11))
        monkeypatch.setattr(parts, "STATES", 40)
    if way == "joins":
        monkeypatch.setattr(parts, "searched", lambda _, asked, paths_too: search.relaxed_many(search.numbered(graph_), asked, paths_too))
    if way == "parts by place":
        places = spark.createDataFrame([(i, float(i % 8), float(i // 8)) for i in range(50)] + [(50, None, 1.0), (51, float("nan"), 1.0)], "id long, x double, y double")
        graph_ = search.loaded(graph_, places)
    got = search.one_to_many(graph_, origins, paths_too=True).collect()
    have = {(r.origin, r.hour, r.target): (r.seconds, [p.node for p in r.path], r.settled) for r in got}
    assert len(have) == len(got)
    want = {}
    for o, h, targets in asked[:-1]:
        seconds, paths, settled = plain(rows, o, targets or [1000], h)
        want |= {(o, h, t): (seconds[t], paths[t], settled) for t in (seconds if targets is None else targets) if t in seconds}
    assert have == want
    assert all(p[-1].seconds == r.seconds and sum(b.seconds - a.seconds for a, b in zip(p, p[1:])) + p[0].seconds == r.seconds for r in got for p in [r.path] if p)


STEP = "route int, seq int, kind string, line string, seconds int, distance_m double"


def test_legs(spark):
    steps = [(1, 0, "ACCESS", None, 60, 72.0), (1, 1, "BOARD", "2", 90, None), (1, 2, "RIDE", "2", 100, None), (1, 3, "TRANSFER", "3", 150, None), (1, 4, "RIDE", "3", 120, None), (1, 5, "ALIGHT", "3", 40, None), (1, 6, "ACCESS", None, 60, 72.0)]
    steps += [(2, 0, "BOARD", "2", 90, None), (2, 1, "RIDE", "2", 100, None), (2, 2, "RIDE", "2", 110, None), (2, 3, "ALIGHT", "2", 44, None)]
    steps += [(3, 0, "RIDE", "2", 10, None), (3, 1, "ALIGHT", "2", 44, None), (3, 2, "BOARD", "5", 200, None), (3, 3, "RIDE", "5", 10, None)]
    got = routes.legs(spark.createDataFrame(steps, STEP)).orderBy("route", "leg").collect()
    legs = {k: [(r.kind, r.seconds) for r in got if r.route == k] for k in (1, 2, 3)}
    assert legs[1] == [("WALK", 60), ("BOARD", 90), ("RIDE", 100), ("TRANSFER", 150), ("RIDE", 120), ("WALK", 100)]
    assert legs[2] == [("BOARD", 90), ("RIDE", 254)] and [r.stops for r in got if r.route == 2] == [0, 2]
    assert legs[3] == [("RIDE", 10), ("TRANSFER", 244), ("RIDE", 10)]
    t = {r.route: (r.seconds, r.transfers, r.walk_m) for r in routes.totals(routes.legs(spark.createDataFrame(steps, STEP))).collect()}
    assert t == {1: (620, 1, 144.0), 2: (344, 0, 0.0), 3: (264, 1, 0.0)}


def test_matrix_by_room(spark):
    found = spark.createDataFrame([(1, 5, 30, 0, 12.5, "s"), (1, 1, 0, 0, 0.0, "t")], "origin long, target long, seconds long, transfers long, walk_m double, summary string")
    members = spark.createDataFrame([(1, 10, 2, 1), (1, 11, 1, None), (2, 12, 1, 1)], "room_id long, member_id long, joined_at long, node long")
    places = spark.createDataFrame([(1, 20, 3, 5), (1, 21, 2, 1), (1, 22, 1, 9), (2, 23, 1, None)], "room_id long, place_id long, created_at long, node long")
    got = {(r.place_id, r.member_id): (r.row, r.col, r.reachable, r.seconds, r.reason) for r in search.matrix(found, members, places).collect()}
    assert len(got) == 7 and got[20, 10] == (3, 2, True, 30, None) and got[21, 10] == (2, 2, True, 0, None)
    assert got[22, 10] == (1, 2, False, None, "UNREACHABLE") and got[20, 11] == (3, 1, False, None, "NO_WALK_NETWORK") and got[23, 12][4] == "NO_WALK_NETWORK"
    asked = {r.origin: sorted(r.targets) for r in search.requests(members, places, F.lit(8)).collect()}
    assert asked == {1: [1, 5, 9]}


def test_a_whole_way(spark):
    """From a walk node over two lines to another: steps, legs, names, places and the summary."""
    n = lambda i, kind, mode, name, x: (i, kind, mode, f"k{i}", None, name, float(x), 0.0)
    nodes = [n(1, "WALK", "WALK", None, 0), n(2, "STOP", "SUBWAY", "가", 10), n(3, "PLATFORM", "SUBWAY", "가", 10), n(4, "PLATFORM", "SUBWAY", "나", 20), n(5, "PLATFORM", "SUBWAY", "나", 20), n(6, "PLATFORM", "SUBWAY", "다", 30), n(7, "STOP", "SUBWAY", "다", 30), n(8, "STOP", "BUS", "다앞", 31), n(9, "PLATFORM", "BUS", "다앞", 31), n(10, "PLATFORM", "BUS", "라", 40), n(11, "STOP", "BUS", "라", 40), n(12, "WALK", "WALK", None, 32)]
    e = lambda i, a, b, kind, line, w, m=None: (i, a, b, kind, line, w, None, m)
    way = [e(1, 1, 2, "ACCESS", None, 60, 72.04), e(2, 2, 3, "BOARD", "2", 90), e(3, 3, 4, "RIDE", "2", 100), e(4, 4, 5, "TRANSFER", "3", 150), e(5, 5, 6, "RIDE", "3", 120), e(6, 6, 7, "ALIGHT", "3", 40), e(7, 7, 12, "ACCESS", None, 5, 6.0), e(8, 12, 8, "ACCESS", None, 7, 8.0), e(9, 8, 9, "BOARD", "B1", 300), e(10, 9, 10, "RIDE", "B1", 200), e(11, 10, 11, "ALIGHT", "B1", 1)]
    nodes = spark.createDataFrame(nodes, "id long, kind string, mode string, source_id string, line string, name string, x double, y double")
    edges_ = spark.createDataFrame(way, "edge long, src long, dst long, kind string, line string, weight_sec int, by_hour array<short>, distance_m double")
    asked = spark.createDataFrame([(1, None, [11, 1])], "origin long, hour int, targets array<long>")
    found = search.one_to_many(edges_, asked, paths_too=True)
    legs = routes.named(routes.legs(routes.steps(found, edges_, nodes), routes.ROUTE), spark.createDataFrame([("SUBWAY", "2", "2호선", None), ("BUS", "B1", "1번", "간선")], "mode string, source_id string, name string, type string"))
    got = [(r.kind, r.label, r.seconds, r.stops, r.to_name, [p[0] for p in r.path]) for r in legs.orderBy("leg").collect()]
    assert got == [("WALK", None, 60, 0, "가", [0, 10]), ("BOARD", "2호선", 90, 0, "가", [10]), ("SUBWAY", "2호선", 100, 1, "나", [10, 20]), ("TRANSFER", "3", 150, 0, "나", [20]), ("SUBWAY", "3", 120, 1, "다", [20, 30]), ("WALK", None, 52, 0, "다앞", [30, 32, 31]), ("TRANSFER", "1번", 300, 0, "다앞", [31]), ("BUS", "1번", 201, 1, "라", [31, 40])]
    sums = {r.target: (r.seconds, r.transfers, r.walk_m, r.summary) for r in routes.summaries(found, legs).collect()}
    assert sums == {11: (1073, 2, 86.0, "17분 53초 · 환승 2 · 도보 86m · 2호선 → 3 → 1번"), 1: (0, 0, 0.0, "0분 0초 · 환승 0 · 도보 0m · 도보")}
    ends = routes.endpoints(spark.createDataFrame([("가", "SUBWAY"), ("가", "BUS"), ("127.0,38.0", "SUBWAY"), ("x,1", "BUS")], "text string, mode string"), nodes.withColumn("x", F.col("x") + 200_000).withColumn("y", F.lit(600_010.0)))
    at = {(r.text, r.mode): (r.node, r.snap_m) for r in ends.collect()}
    assert at["가", "SUBWAY"] == (2, 0.0) and at["가", "BUS"][0] is None and at["x,1", "BUS"][0] is None
    assert at["127.0,38.0", "SUBWAY"][0] == 1 and at["127.0,38.0", "SUBWAY"][1] == pytest.approx(10, abs=0.01)


def test_graph_parts(spark):
    fixed, applied, stale = graph.repaired(spark.createDataFrame([("a", 1.0, 1.0)], "source_id string, x double, y double"), spark.createDataFrame([("a", 2.0, 3.0), ("z", 0.0, 0.0)], "source_id string, x double, y double"))
    assert tuple(fixed.first()) == ("a", 2.0, 3.0) and applied == 1 and stale.count() == 1
    waits = spark.createDataFrame([("s", "1", [60] * 23 + [-1]), ("s", "2", None)], "source_id string, line string, by_hour array<short>")
    walks = spark.createDataFrame([("s", "1", 44)], "source_id string, line string, sec int")
    board, alight = graph.board_edges(waits, walks, "SUBWAY")
    assert [(r.weight_sec, r.by_hour[0], r.by_hour[23], r.mode) for r in board.collect()] == [(104, 104, -1, "SUBWAY")] and sorted(r.weight_sec for r in alight.collect()) == [1, 44]
    known = spark.createDataFrame([("s", "1", "3", 99)], PAIR)
    platforms = spark.createDataFrame([("s", x) for x in ("1", "3", "3급행", "2성수지선")], "station string, line string")
    t = {(r.line_a, r.line_b): (r.sec, r.fallback) for r in graph.transfer_seconds(platforms, known).collect()}
    assert t["1", "3"] == t["1", "3급행"] == (99, False) and t["3", "3급행"] == (30, False) and t["3", "1"] == (180, True) and t["1", "2성수지선"] == (180, True)
    names = [("k", "k", 0.0), ("k", "b", 1.0), ("k", "a", 2.0), ("one", "x", 5.0)]
    stops = graph.stop_nodes(spark.createDataFrame(names, "source_id string, name string, x double").withColumn("y", F.col("x")), "SUBWAY")
    assert {(r.source_id, r.name, r.x) for r in stops.collect()} == {("k", "k(a,b)", 1.0), ("one", "x", 5.0)}
    e = spark.createDataFrame([(1,), (1,), (1 << 59,), (7,)], "src long")
    assert sorted((r.node, r.degree, r["head"]) for r in graph.heads(e).collect()) == [(1, 2, 0), (7, 1, 2), (1 << 59, 1, 3)]


def test_bus_part(spark):
    shut = [-1] * 24
    sections = spark.createDataFrame([("r", "a", "b", [9000] + [50] * 23), ("r", "b", "c", shut), ("q", "a", "b", [50] * 24), ("r", "b", "gone", [50] * 24)], "route string, a string, b string, by_hour array<int>")
    stops = spark.createDataFrame([(x, x, 1.0 if x != "gone" else None, 1.0) for x in ("a", "b", "c", "d", "gone")], "source_id string, name string, x double, y double")
    headways = graph.route_headways(spark.createDataFrame([("7", "8.5"), ("7", "0"), ("8", "x")], "number string, minutes string"), spark.createDataFrame([("7", "r", 1), ("8", "q", 2)], "number string, route string, ord int"))
    assert [tuple(r) for r in headways.collect()] == [("r", 510)]
    part = graph.bus(sections, stops, headways)
    rows = part.edges.collect()
    assert sorted(r.kind for r in rows) == ["ALIGHT"] * 3 + ["BOARD"] * 3 + ["RIDE"]
    ride = [r for r in rows if r.kind == "RIDE"][0]
    assert ride.by_hour[0] == 3600 and ride.weight_sec == 50 and {r.weight_sec for r in rows if r.kind == "BOARD"} == {255}
    assert sorted((r.kind, r.source_id) for r in part.nodes.collect()) == [("PLATFORM", x) for x in "abc"] + [("STOP", x) for x in "abc"]
    kinds = spark.createDataFrame([("1", "n", "경기"), ("2", "n", None), ("3", "n", "간선")], "route string, name string, type string")
    assert [r.route for r in graph.city_routes(kinds).orderBy("route").collect()] == ["2", "3"]


def test_spatial_helpers(spark):
    assert clamped(0, 0) == (2000, 50) and clamped(99_999, 999) == (10_000, 200)


@pytest.mark.parametrize("size", [1, 3, 256])
def test_the_nearest_however_far(spark, monkeypatch, size):
    import random

    from waymill.operators import spatial

    rng = random.Random(size)
    monkeypatch.setattr(spatial, "BOXES", 5)
    nan, inf = float("nan"), float("inf")
    cluster = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)] + [(1e6 + rng.gauss(0, 50), -4e5) for _ in range(40)] + [(7.0, 7.0)] * 30
    right = [(i, x, y) for i, (x, y) in enumerate(cluster)] + [(900, nan, 0.0), (901, 0.0, None), (902, inf, 0.0), (None, 0.0, 0.0)]
    left = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(40)] + [(50, 9e7, 0.0), (51, -3e5, 4e5), (52, 1e6, -4e5), (53, 7.0, 7.0), (60, None, 1.0), (61, nan, 1.0), (62, 1.0, inf), (None, 1.0, 1.0)]
    got = {r.l: (r.r, r.distance) for r in nearest_any(spark.createDataFrame(left, "l int, lx double, ly double"), spark.createDataFrame(right, "r int, rx double, ry double"), "l", "r", size).collect()}
    root = lambda a, b: (((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5, b[0])
    want = {a[0]: min(root(a, b) for b in right[:-4]) for a in left[:-4]}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}) and {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    none = spark.createDataFrame([(1, nan, 0.0)], "r int, rx double, ry double")
    assert nearest_any(spark.createDataFrame(left, "l int, lx double, ly double"), none, "l", "r").count() == 0


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "a.csv"
    header = ",".join(readers.LICENCE_COLUMNS)
    good = ",".join(["1", "A-1"] + [""] * 6 + [" 가게 "] + [""] * 30)
    path.write_bytes((header + "\n" + good + "\n" + good + ",extra\n").encode("cp949"))
    df = readers.licences(spark, readers.Source("X", "x", str(path)))
    assert df.count() == 1 and df.select("biz_name").first()[0].strip() == "가게"
    assert readers.accepted(str(path), None, readers.LICENCE_COLUMNS, "a") == []
    assert readers.accepted(str(path), None, ["b"], "b") == ["name", "header"]
    bom = tmp_path / "b.csv"
    bom.write_text("﻿LINE,STT\n2,05:00:00\n", encoding="utf-8")
    assert readers.csv(spark, str(bom), columns=["LINE"]).first()[0] == "2"
    assert len(readers.file_sha256(str(path))) == 64


def test_graphml(spark, tmp_path):
    path = tmp_path / "w.graphml"
    path.write_text('<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><graph><node id="1"><data key="d0">1.5</data><data key="d1">2.5</data></node><node id="2"><data key="d0">3</data><data key="d1">4</data></node><edge source="1" target="2"><data key="d2">12.25</data></edge></graph></graphml>')
    nodes, e = readers.walk_network(spark, str(path))
    assert [tuple(map(float, r)) for r in nodes.orderBy("id").collect()] == [(1, 1.5, 2.5), (2, 3, 4)]
    assert float(e.first().length) == 12.25


def test_rate_limit_batch(spark):
    rows = [("a", t, k) for k, t in enumerate((0, 10, 20, 30, 65, 70))] + [("b", 5, 9)]
    df = spark.createDataFrame(rows, "k string, t int, n int").withColumn("ts", F.timestamp_seconds("t"))
    df = df.unionByName(spark.createDataFrame([("a", None, 77)], "k string, t int, n int").withColumn("ts", F.timestamp_seconds("t")))
    got = [r.allowed for r in rooms_op.limited(df.select("k", "ts", "n"), "k", "ts", 2, 60).orderBy("k", "ts").collect()]
    assert got == [False, True, True, False, False, True, True, True]


def test_point_routes_equal_their_sql(spark):
    import os

    import duckdb

    from waymill.plans import graphs

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in "nation customer supplier part lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = graphs.point_routes(spark, d)
    r = con.execute(graphs.POINT_ROUTES_SQL)
    names = [c[0] for c in r.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(r.fetchall(), key=repr)
