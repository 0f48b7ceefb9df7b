"""Builds, retention by folders, rooms as events, coordinate systems, sheets and names, with values worked out by hand or by plain code."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from waymill.functions import crs
from waymill.operators import builds, graph, ingest, names, rooms, verdicts
from waymill.sources import readers, sheets

NODES = "id long, kind string, mode string, source_id string, line string, name string, x double, y double"
EDGES = "edge long, src long, dst long, kind string, mode string, line string, weight_sec int, by_hour array<short>, distance_m double"


def part(spark, n):
    nodes = [(i, "WALK", "WALK", str(i), None, None, float(i), 0.0) for i in range(n)]
    edges = [(i, i, i + 1, "WALK", "WALK", None, 1, None, 1.0) for i in range(n - 1)]
    return graph.Part(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_builds_are_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)
    assert builds.active(spark, folder) is None
    cache = builds.Cache(spark, folder)
    with pytest.raises(LookupError):
        cache.get()
    assert builds.publish(spark, folder, lambda: part(spark, 3)) == 1
    assert cache.get()[0] == 1 and not cache.stale()

    def broken():
        raise OSError("disk full")

    def refuse(_):
        raise ValueError("not good enough")

    with pytest.raises(OSError):
        builds.publish(spark, folder, broken)
    with pytest.raises(ValueError):
        builds.publish(spark, folder, lambda: part(spark, 4), check=refuse)
    assert builds.active_id(spark, folder) == 1 and builds.active(spark, folder)[1].nodes.count() == 3 and not cache.stale()
    assert builds.publish(spark, folder, lambda: part(spark, 5)) == 4
    assert cache.stale() and cache.get()[0] == 4 and cache.get()[1].nodes.count() == 5
    rows = {r.id: (r.status, r.nodes, r.edges, r.active) for r in builds.ledger(spark, folder).collect()}
    assert rows == {1: ("SUCCESS", 3, 2, False), 2: ("FAILED", None, None, False), 3: ("FAILED", None, None, False), 4: ("SUCCESS", 5, 4, True)}
    # The build before stays for readers that hold it, failed ones go; with the next one the oldest goes too.
    left = lambda: sorted(int(n.split("-")[0]) for n in os.listdir(f"{folder}/builds"))
    assert left() == [1, 4]
    builds.publish(spark, folder, lambda: part(spark, 6))
    assert left() == [4, 5]


def test_a_pointer_moves_once_for_each_version(spark, tmp_path):
    folder = str(tmp_path)
    builds.publish(spark, folder, lambda: part(spark, 3))
    at, system = builds._path(spark, f"{folder}/versions/{2:012d}")
    system.createNewFile(at)
    with pytest.raises(RuntimeError, match="another writer"):
        builds.publish(spark, folder, lambda: part(spark, 4))
    assert builds.active_id(spark, folder) == 1


def test_expired_runs_go_by_folders_and_others_are_untouched(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert ingest.expire_partitions(spark, folder, 2) == 0
    rows = [("A b", r, i) for r in (1, 2, 5, 8) for i in range(3)] + [("B", 3, 0), ("B", 9, 0)]
    readers.write_runs(spark.createDataFrame(rows, "source string, run_id int, v int"), folder, "source", "run_id")
    os.makedirs(f"{folder}/source=B/run_id=11")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs}
    before = files()
    assert ingest.expire_partitions(spark, folder, 2) == 2
    after = files()
    assert after.items() <= before.items() and all("run_id=1/" in f or "run_id=2/" in f for f in before.keys() - after.keys())
    got = {(r.source, r.run_id) for r in spark.read.parquet(folder).select("source", "run_id").collect()}
    assert got == {("A b", 5), ("A b", 8), ("B", 3), ("B", 9)}
    assert ingest.expire_partitions(spark, folder, 2) == 0


EVENT = "room_id long, seq long, user_id long, action string"


def test_rooms_fill_empty_and_change_hands(spark):
    j, q = "JOIN", "LEAVE"
    told = [(1, 1, 7, j, "CREATED"), (1, 2, 8, j, "JOINED"), (1, 3, 8, j, "AGAIN"), (1, 4, 9, j, "FULL"), (1, 5, 9, q, "NOT_A_MEMBER"), (1, 6, 7, q, "HANDED_OVER"), (1, 7, 9, j, "JOINED"), (1, 8, 7, j, "FULL"), (1, 9, 9, q, "LEFT"), (1, 10, 8, q, "DELETED"), (1, 11, 8, j, "NOT_FOUND"), (2, 1, 5, q, "NOT_A_MEMBER"), (2, 2, 5, j, "CREATED")]
    events = [t[:4] for t in told] + [(None, 1, 1, j), (3, None, 1, j), (3, 1, None, j), (3, 1, 1, "LOOK")]
    df = spark.createDataFrame(events, EVENT).repartition(4).withColumn("owner_id", F.lit("theirs")).withColumn("row", F.lit(1))
    out = rooms.folded(df, 2)
    assert out.columns == ["room_id", "seq", "user_id", "action", "row", "outcome", "owner_id", "members"]
    assert {(r.room_id, r.seq): r.outcome for r in out.collect()} == {t[:2]: t[4] for t in told}
    assert [tuple(r) for r in rooms.standing(out).collect()] == [(2, 5, [5])]
    assert rooms.folded(df.limit(0)).count() == 0


def test_verdicts_on_coordinate_systems(spark):
    anchors = (verdicts.Anchor("one", "동 29", 37.5130, 127.1027), verdicts.Anchor("two", "동 7", 37.55, 127.0), verdicts.Anchor("none", "동 500", 37.5, 127.0))
    rows = [("서울 동 29", 209010.0, 445647.0), ("서울 동 29-3", 209020.0, 445647.0), ("서울 동 293", 0.0, 0.0), ("서울 동 29", None, 1.0), ("서울 동 29", float("nan"), 1.0), (None, 200000.0, 450000.0), ("x", 209030.0, 445647.0)]
    df = spark.createDataFrame(rows, "jibun string, x double, y double")
    got = verdicts.judged(verdicts.anchor_errors(df, anchors=anchors), anchors=anchors).collect()
    first = got[0]
    assert first.label == "EPSG:5174" and first.best and first.verdict == "PASS" and first.samples == 2 and first.median_m < 10 and first.inside == 0.8
    assert [(a.name, a.samples) for a in first.anchors] == [("one", 2), ("two", 0), ("none", 0)] and first.anchors[1].median_m is None
    assert [r.place for r in got] == [1, 2, 3, 4, 5, 6] and [r.median_m for r in got] == sorted(r.median_m for r in got)
    assert got[-1].label.startswith("control") and got[-1].verdict == "FAIL"
    control = (verdicts.Candidate("control", crs.EPSG_5174, crs.KOREAN_1985, True), verdicts.Candidate("other", crs.EPSG_2097, crs.KOREAN_1985))
    judged = verdicts.judged(verdicts.anchor_errors(df, control, anchors), control, anchors).collect()
    assert [(r.label, r.best) for r in judged] == [("control", False), ("other", True)]
    nothing = verdicts.judged(verdicts.anchor_errors(df.where("x IS NULL"), anchors=anchors), anchors=anchors).collect()
    assert {(r.verdict, r.median_m, r.samples, r.best) for r in nothing} == {("NO_DATA", None, 0, False)}
    pairs = {(r.a, r.b): (r.n, r.median_m) for r in verdicts.spread(df.withColumn("id", F.monotonically_increasing_id()), "id", sample=3).collect()}
    assert len(pairs) == 15 and all(n == 3 for n, _ in pairs.values()) and pairs["EPSG:5174", "EPSG:2097"][1] > 200
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "k int, x double, y double")
    agreed = verdicts.agreement(a, a.withColumn("x", F.col("x") + 0.002), "k").first()
    assert agreed.n == 2 and agreed.max_m == pytest.approx(0.002) and not agreed.agrees and verdicts.agreement(a, a, "k").first().agrees


def workbook(path):
    cell = lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{r}"><v>{v}</v></c>'
    row = lambda n, *cells: f'<row r="{n}">{"".join(cell(f"{c}{n}", v) for c, v in cells)}</row>'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = ["노선번호", "배차간격", "0017", "<b>&</b>", "노선명", "ROUTEID"]
    escaped = [s.replace("&", "&amp;").replace("<", "&lt;") for s in shared]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="평일" sheetId="1" r:id="r1"/><sheet name="토요일" sheetId="2" r:id="r2"/><sheet name="노선" sheetId="3" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/><Relationship Id="r3" Target="worksheets/c.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{s}</t></r><rPh><t>read aloud</t></rPh></si>" for s in escaped) + "</sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {space}><sheetData>{row(1, ("A", 0), ("C", 1))}{row(3, ("A", 2), ("C", "8.5"))}<row r="4"><c r="A4" t="inlineStr"><is><t>N1</t></is></c><c r="C4" t="str"><f>1+1</f><v>0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {space}><sheetData>{row(1, ("A", 0), ("C", 1))}{row(2, ("A", 2), ("B", 3), ("C", "20"))}</sheetData></worksheet>')
        z.writestr("xl/worksheets/c.xml", f'<worksheet {space}><sheetData>{row(1, ("A", 4), ("B", 5))}{row(2, ("A", 2), ("B", "100100124"))}</sheetData></worksheet>')


def test_sheets_of_a_workbook(spark, tmp_path):
    path = str(tmp_path / "headways.xlsx")
    workbook(path)
    rows = sorted((r.sheet, r.row, r.cells) for r in sheets.cells(spark, path).collect())
    assert ("평일", 3, ["0017", None, "8.5"]) in rows and ("토요일", 2, ["0017", "<b>&</b>", "20"]) in rows and ("평일", 4, ["N1", None, "0"]) in rows
    routes = sheets.sheet(spark, path, "노선")
    got = {day: [tuple(r) for r in graph.sheet_headways(sheets.sheet(spark, path, day), routes).collect()] for day in ("평일", "토요일")}
    assert got == {"평일": [("100100124", 510)], "토요일": [("100100124", 1200)]}
    assert sheets.sheet(spark, path).columns == ["노선번호", "배차간격", "_row"]
    with pytest.raises(Exception, match="no sheet"):
        sheets.cells(spark, path, "일요일").count()
    assert [sheets.column_of(c) for c in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]


def test_names_by_their_grams(spark):
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc %_\\가") for _ in range(rng.randrange(9))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (500, None)], "id long, name string")
    wanted = sorted({"".join(rng.choice("abc%_\\가") for _ in range(rng.randrange(5))) for _ in range(40)})
    found = names.containing(df, names.index(df), spark.createDataFrame([(w,) for w in [*wanted, wanted[0], None]], "text string"))
    like = lambda q, t: re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in q), t, re.S)
    assert sorted((r.text, r.id) for r in found.collect()) == sorted((w, i) for w in wanted for i, t in enumerate(texts) if like(w, t))
    top = names.best(found.where(F.col("text") == "a"), 3).orderBy("place").collect()
    assert [r.name for r in top] == sorted(t for t in texts if "a" in t)[:3]


def test_files_in_any_store_are_hashed_and_checked(spark, tmp_path):
    header = readers.LICENCE_COLUMNS
    line = ",".join(["1", "가", *[""] * (len(header) - 2)])
    lines = spark.createDataFrame([(line,)] * 5, "line string").repartition(2)
    for name, n in (("a", 5), ("b", 5), ("c", 3)):
        readers.write_lines(lines.limit(n), str(tmp_path / name), ",".join(header))
    assert readers.contents_sha256(spark, str(tmp_path / "a")) != readers.contents_sha256(spark, str(tmp_path / "c"))
    assert readers.against(spark, str(tmp_path / "a"), str(tmp_path / "b"), header) == []
    assert readers.against(spark, str(tmp_path / "c"), str(tmp_path / "a"), header, least=0.9) == ["size"]
    assert readers.against(spark, str(tmp_path / "a"), None, ["other"]) == ["header"]
    raw = readers.licences(spark, readers.Source("X", "x", str(tmp_path / "a"))).collect()
    assert len(raw) == 5 and {r.mgmt_no for r in raw} == {"가"}


def test_tables_between_jobs_are_removed_with_their_scope(spark, tmp_path):
    from waymill.scratch import scope, written

    with pytest.raises(RuntimeError, match="stop"), scope(spark):
        table = written(spark.range(5), "scoped")
        kept = table.where("id > 2")
        kept.write.parquet(str(tmp_path / "kept"))
        folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder)
        raise RuntimeError("stop")
    assert not os.path.isdir(folder) and spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_optional_filters_and_parallel_arrays(spark):
    from waymill.operators import places, reports

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert [r.k for r in reports.filtered(df, k=None, v="b").collect()] == [2] and reports.filtered(df, k=None, v=None).count() == 3
    arrays = spark.createDataFrame([(1, ["x", "y"], [7])], "k int, a array<string>, b array<int>")
    assert [tuple(r) for r in reports.unnested(arrays, ["a", "b"]).collect()] == [(1, 1, "x", 7), (1, 2, "y", None)]
    some = spark.createDataFrame([(1, "tea room", 0.0, 0.0, "ACTIVE", "c"), (2, "tea", 30.0, 40.0, "ACTIVE", "d"), (3, "tea", 1.0, 0.0, "CLOSED", "c"), (4, "a\\tea%", 9e5, 0.0, "ACTIVE", None), (5, "tea", None, None, "ACTIVE", "c")], "id long, name string, x double, y double, status string, category string")
    found = lambda *a, **k: [(r.id, r.distance_m) for r in places.search(some, *a, **k).collect()]
    assert found("tea") == [(4, None), (2, None), (5, None), (1, None)]
    assert found("tea", (0.0, 0.0)) == [(1, 0.0), (2, 50.0), (4, 900000.0), (5, None)] and found("tea", (0.0, 0.0), 50) == [(1, 0.0), (2, 50.0)] and found("tea", (0.0, 0.0), 0, 2) == [(1, 0.0), (2, 50.0)]
    assert found("t_a", closed=True, category="c") == [(3, None), (5, None), (1, None)] and found("tea", category=" ") == found("tea") and found("\\t") == [(4, None)]
    assert [r.id for r in places.nearby(some, 0.0, 0.0, 100, closed=True).collect()] == [1, 3, 2] and [r.id for r in places.nearby(some, 0.0, 0.0, category="d").collect()] == [2]


def test_details_know_sources_apart(spark):
    from waymill.operators import places

    rows = spark.createDataFrame([(1, "A", "x", 1, 2), (2, "B", "x", 2, 9), (3, "A", "y", None, None)], "id long, source string, source_id string, first_seen int, last_seen int")
    runs = spark.createDataFrame([(1, "A", "d1"), (2, "B", "d2"), (3, "A", "d3")], "id int, source string, snapshot_date string")
    findings = spark.createDataFrame([(1, "x", "R1", "WARN", "{}"), (3, "x", "R2", "ERROR", "{}"), (3, "x", "R1", "ERROR", None), (2, "x", "R9", "WARN", "{}"), (9, "x", "R1", "WARN", "{}")], "run_id int, target_id string, rule_code string, severity string, detail string")
    got = {r.id: (r.first_date, r.last_date, [(f.run_id, f.rule_code) for f in r.findings]) for r in places.details(rows, runs, findings, 2).collect()}
    assert got == {1: ("d1", "d2", [(3, "R1"), (3, "R2")]), 2: ("d2", None, [(2, "R9")]), 3: (None, None, [])}


def test_lines_paths_and_reports(spark, tmp_path):
    from waymill.operators import routes
    from waymill.operators.spatial import in_box

    lines = spark.createDataFrame([("2",), ("2성수지선",), ("9급행",), ("2",)], "line string")
    buses = spark.createDataFrame([("100", "7번", "간선"), ("101", "8번", None)], "route string, name string, type string")
    known = routes.dictionary(lines, buses)
    got = {tuple(r) for r in known.collect()}
    assert got == {("SUBWAY", "2", "2호선", None), ("SUBWAY", "2성수지선", "2호선 성수지선", "성수지선"), ("SUBWAY", "9급행", "9호선 급행", "급행"), ("BUS", "100", "7번", "간선"), ("BUS", "101", "8번", None)}
    fresh = spark.createDataFrame([("BUS", "100", "9번", None), ("BUS", "102", "x", "y")], known.schema)
    after = {(r.mode, r.source_id): r.name for r in ingest.overwrite(known, fresh, ["mode", "source_id"]).collect()}
    assert len(after) == 6 and after["BUS", "100"] == "9번" and after["BUS", "101"] == "8번"
    legs = spark.createDataFrame([(1, None, 1, "WALK", [[200000.0, 600000.0], [200100.0, 600000.0]]), (1, None, 2, "BOARD", [])], "o int, hour int, leg int, kind string, path array<array<double>>")
    paths = {r.leg: r.path for r in routes.in_degrees(legs, ["o", "hour"]).collect()}
    assert paths[1][0] == [127.0, 38.0] and paths[1][1][0] == pytest.approx(127.001139, abs=2e-6) and paths[2] == []
    readers.write_report(known, str(tmp_path / "csv"))
    readers.write_report(known, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5 and spark.read.json(str(tmp_path / "json")).where("type = '간선'").first().name == "7번"
    box = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in box.select(in_box(F.col("x"), F.col("y"), 0.0, 0.0, 2.0, 2.0)).collect()] == [True, False, None]


def test_clusters_hold_neighbours_and_are_bounded(spark):
    from waymill.operators import parts

    chains = [(1000 * c + i, 1000 * c + i + 1) for c in range(4) for i in range(60)]
    hub = [(5000, 5001 + i) for i in range(50)]
    edges = spark.createDataFrame(chains + hub + [(7000, 7000), (0, 1000)], "src long, dst long")
    got = {r.node: r.cluster for r in parts.clusters(edges, 20).collect()}
    assert set(got) == {n for e in chains + hub + [(7000, 7000)] for n in e}
    sizes = {c: sum(v == c for v in got.values()) for c in set(got.values())}
    assert max(sizes.values()) <= 20 and sum(got[a] != got[b] for a, b in chains) < len(chains) / 4
    assert got == {r.node: r.cluster for r in parts.clusters(edges.repartition(7), 20).collect()}
    assert {r.cluster for r in parts.clusters(edges.where("src >= 5000"), 1).collect()} == {n for e in hub for n in e} | {7000}


def test_a_graph_divided_by_clusters_gives_the_kernels_rows(spark):
    from waymill.operators import parts, search

    rng = random.Random(8)
    rows = [(i, i + 1, rng.randrange(1, 9)) for i in range(80)] + [(i + 1, i, rng.randrange(1, 9)) for i in range(80)] + [(rng.randrange(80), rng.randrange(80), 30) for _ in range(12)] + [(90, 91, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight_sec int")
    asked = spark.createDataFrame([(0, None, None), (40, None, [3, 79, 91]), (90, None, None), (91, None, None)], "origin long, hour int, targets array<long>")
    ready = search.loaded(edges)
    shown = lambda df: sorted((r.origin, r.target, r.seconds, r.settled, [tuple(s) for s in r.path]) for r in df.collect())
    assert shown(parts.searched(parts.divided(ready.edges, None, 24), asked, True)) == shown(search.one_to_many(ready, asked, paths_too=True))


def test_walk_edges_are_summed_without_being_made(spark):
    """Counts, degrees and isolated nodes from places alone equal those of the edges, with many nodes at a place and none near one."""
    rows = [(i, float(i % 7 * 300), float(i % 3 * 400)) for i in range(60)] + [(100, 90_000.0, 0.0), (101, 50_000.0, 0.0), (102, 50_000.0, 0.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    edges = graph.walks_within(nodes, 800.0)
    want = {r.src: tuple(r)[1:] for r in edges.groupBy("src").agg(F.count("*"), F.sum("weight_sec"), F.max("weight_sec"), F.round(F.sum("distance_m"), 6)).collect()}
    sums = graph.walk_sums(nodes, 800.0)
    assert {r.src: (r.degree, r.seconds, r.most, round(r.metres, 6)) for r in sums.collect()} == want and 100 not in want and 101 in want
    some = edges.limit(0)
    assert sorted(graph.heads(some, sums).collect()) == sorted(graph.heads(edges).collect())
    whole = nodes.withColumn("kind", F.lit("WALK")).withColumn("mode", F.lit("WALK"))
    assert sorted(graph.counts(whole, some, sums).collect()) == sorted(graph.counts(whole, edges).collect())
    assert [r.id for r in graph.isolated(whole, some, sums).collect()] == [100]
