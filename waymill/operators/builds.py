"""Published graph builds: a folder for each, a ledger, and a pointer that changes in one step.

A reader takes the build that the pointer names and never sees half a build: nodes and edges are complete before the
pointer moves, and a pointer is a file that is renamed into place under the next version's name, which only one
writer can do. What failed or was replaced stays readable until it is pruned.

A walk network may be stored by its places in reach of each other (``graph.Part``): its edges grow with the square of the nodes
at a place, and readers make them from the places and nodes of the build.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.operators import graph, search

LEDGER = "id long, step int, status string, folder string, nodes long, edges long, counts string, message string"


def _path(spark: SparkSession, path: str):
    """(the path, its file system) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, system = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(id, status, folder, nodes, edges, counts, message) of every build as it stands, with ``active``."""
    _, system = _path(spark, folder)
    rows = spark.read.schema(LEDGER).parquet(f"{folder}/ledger") if _names(spark, f"{folder}/ledger") else spark.createDataFrame([], LEDGER)
    now = rows.groupBy("id").agg(F.max_by(F.struct(*[c.split()[0] for c in LEDGER.split(", ")[2:]]), "step").alias("r")).select("id", "r.*")
    current = active_id(spark, folder)
    return now.withColumn("active", F.col("id").eqNullSafe(F.lit(current)) if current is not None else F.lit(False))


def active_id(spark: SparkSession, folder: str) -> int | None:
    """The build that the newest pointer names."""
    pointers = [n for n in _names(spark, f"{folder}/active") if not n.startswith((".", "_"))]
    return int(pointers[-1].split("-")[1]) if pointers else None


def _note(spark: SparkSession, root: str, build: int, step: int, status: str, **more) -> None:
    row = {"id": build, "step": step, "status": status} | more
    spark.createDataFrame([tuple(row.get(c.split()[0]) for c in LEDGER.split(", "))], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def publish(spark: SparkSession, folder: str, make: Callable[[], graph.Part], check: Callable[[graph.Part], None] | None = None, keep: int = 1) -> int:
    """Writes what ``make`` gives as a new build, has it checked, and makes it the active one; returns its id.

    Where anything fails before the pointer moves, the build is FAILED in the ledger, the active one stays, and the error is raised.
    Of the others the ``keep`` latest successful ones stay; that older ones can't be removed fails nothing.
    """
    build = (ledger(spark, folder).agg(F.max("id")).first()[0] or 0) + 1
    place = f"{folder}/builds/{build:012d}-{uuid4().hex[:8]}"
    _note(spark, folder, build, 0, "RUNNING", folder=place)
    try:
        part = make()
        part.nodes.write.parquet(f"{place}/nodes")
        part.edges.write.parquet(f"{place}/edges")
        if part.places is not None:
            part.places.write.parquet(f"{place}/places")
        done = stored(spark, place)
        if check is not None:
            check(read(spark, place))
        sums = None if done.places is None else graph.walk_sums(walks(done), 0.0, done.places)
        counted = counts_json(graph.counts(done.nodes, done.edges, sums)).first()
        _point(spark, folder, build)
    except Exception as e:
        _note(spark, folder, build, 1, "FAILED", folder=place, message=f"{type(e).__name__}: {e}"[:500])
        raise
    _note(spark, folder, build, 1, "SUCCESS", folder=place, nodes=counted.nodes, edges=counted.edges, counts=counted.counts)
    try:
        prune(spark, folder, keep)
    except Exception as e:  # noqa: BLE001 - what can't be removed now is removed after a later build
        _note(spark, folder, build, 2, "SUCCESS", folder=place, nodes=counted.nodes, edges=counted.edges, counts=counted.counts, message=f"not pruned: {e}"[:500])
    return build


def counts_json(counts: DataFrame) -> DataFrame:
    """One row (nodes, edges, counts): totals of graph.counts, and all its rows as one JSON document in order."""
    total = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("count"))), F.lit(0))
    rows = F.array_sort(F.collect_list(F.struct(*counts.columns)))
    return counts.agg(total("NODE").alias("nodes"), total("EDGE").alias("edges"), F.to_json(rows).alias("counts"))


def _point(spark: SparkSession, folder: str, build: int) -> None:
    """Moves the pointer: a file named by the next version appears by renaming, or an error if another writer was first."""
    names = [n for n in _names(spark, f"{folder}/active") if not n.startswith((".", "_"))]
    version = int(names[-1].split("-")[0]) + 1 if names else 1
    claim, system = _path(spark, f"{folder}/versions/{version:012d}")
    if not system.createNewFile(claim):
        raise RuntimeError(f"version {version} of {folder} was published by another writer")
    temporary, _ = _path(spark, f"{folder}/versions/{uuid4().hex}")
    system.createNewFile(temporary)
    target, _ = _path(spark, f"{folder}/active/{version:012d}-{build:012d}")
    system.mkdirs(target.getParent())
    if not system.rename(temporary, target):
        raise OSError(f"the pointer of {folder} couldn't be moved")


def prune(spark: SparkSession, folder: str, keep: int) -> list[int]:
    """Removes the folders of failed builds and of successful ones beyond the active and the ``keep`` latest before it."""
    rows = ledger(spark, folder).where("status IN ('SUCCESS', 'FAILED')").orderBy(F.desc("id")).select("id", "status", "folder", "active").collect()
    stay = {r.id for r in rows if r.active} | {r.id for r in [r for r in rows if r.status == "SUCCESS" and not r.active][:keep]}
    gone = []
    for r in rows:
        at, system = _path(spark, r.folder)
        if r.id not in stay and system.exists(at):
            system.delete(at, True)
            gone.append(r.id)
    return gone


def stored(spark: SparkSession, place: str) -> graph.Part:
    """A build as it is stored: walk edges by places if it was published so."""
    at, system = _path(spark, f"{place}/places")
    places = spark.read.parquet(f"{place}/places") if system.exists(at) else None
    return graph.Part(spark.read.parquet(f"{place}/nodes"), spark.read.parquet(f"{place}/edges"), places)


def walks(part: graph.Part) -> DataFrame:
    return part.nodes.where("kind = 'WALK'").select("id", "x", "y")


def read(spark: SparkSession, place: str) -> graph.Part:
    """A build with all its edges."""
    part = stored(spark, place)
    return part if part.places is None else graph.Part(part.nodes, part.edges.unionByName(graph.walks_between(walks(part), part.places)))


def active(spark: SparkSession, folder: str) -> tuple[int, graph.Part] | None:
    """(id, graph) of the active build; none before the first."""
    current = active_id(spark, folder)
    if current is None:
        return None
    place = next(n for n in _names(spark, f"{folder}/builds") if int(n.split("-")[0]) == current)
    return current, read(spark, f"{folder}/builds/{place}")


@dataclass
class Cache:
    """The active build of a folder, loaded for searches when it is first asked for and again when the pointer has moved."""

    spark: SparkSession
    folder: str
    build: int | None = None
    part: graph.Part | None = None
    ready: search.Loaded | None = None

    def stale(self) -> bool:
        return self.build != active_id(self.spark, self.folder)

    def get(self) -> tuple[int, graph.Part, search.Loaded]:
        if self.ready is None or self.stale():
            found = active(self.spark, self.folder)
            if found is None:
                raise LookupError(f"no build of {self.folder} is published")
            old = self.ready
            self.build, self.part = found
            self.ready = search.loaded(self.part.edges, self.part.nodes)
            if old is not None and old.shared is not None:
                old.shared.unpersist()
        return self.build, self.part, self.ready
