"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, and cosine for what meets there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import components, local_labels, written

#: Neighbouring cells probed in each table, the share of pairs at the threshold that may miss each other in all tables, and
#: the range of the edges of a cell against the unit vectors' projections: the longest up to FEW vectors.
PROBES, MISSED, EDGES, FEW = 3, 0.01, (0.09, 0.22), 20_000
#: Effective cells grow as the edge's power -6.5 in the range (measured with unit vectors of 64 numbers).
SHRINK = 6.5
#: A cell of more vectors than this is dealt out as pairs of blocks of about this size.
BLOCK = 4096


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points whose coordinates are integers with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(np.mod(r.sum(axis=1), 2) != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        k = np.abs(gap).argmax(axis=1)
        r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to the neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if v.sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def cell_hash(points: np.ndarray, which: int) -> np.ndarray:
    """A 63-bit number for each lattice point of a table."""
    h = np.full(len(points), 0x9E3779B97F4A7C15 ^ (which * 0x5851F42D), np.uint64)
    for k in range(8):
        h ^= (points[:, k] * 2).astype(np.int64).view(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of doubles brought to length one, by way of their largest component so that nothing over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(unit: np.ndarray, tables: int, probes: int, edge: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed neighbours (n, tables, probes) of unit vectors.

    The neighbours probed are those whose centres lie nearest to the projected vector.
    """
    n, width = unit.shape
    home, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    steps = minimal_vectors()
    for t in range(tables):
        rng = np.random.default_rng([seed, t, width])
        q, _ = np.linalg.qr(rng.normal(size=(max(width, 8), 8)))
        shift = rng.uniform(0, 2, 8)
        x = unit @ q[:width] * np.sqrt(max(width, 8) / 64) / edge + shift
        centre = nearest_e8(x)
        home[:, t] = cell_hash(centre, t)
        gain = (x - centre) @ steps.T
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        for k in range(probes):
            near[:, t, k] = cell_hash(centre + steps[best[:, k]], t)
    return home, near


def numbers(vectors: DataFrame):
    """The embeddings as floats if they come as such, which take half the room in shuffles, else as doubles."""
    e = F.col("embedding")
    return e if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else e.cast("array<double>")


def edge_for(n: int) -> float:
    """The edge at which n vectors fill cells as 20,000 do at the longest edge, as far as the range goes."""
    return float(np.clip(EDGES[1] * (max(n, 1) / FEW) ** (-1 / SHRINK), *EDGES))


def tables_for(width: int, least: float, probes: int, edge: float, seed: int) -> int:
    """Tables after which at most MISSED of random pairs of the cosine ``least`` have not met, by how often 4,000 meet in one."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 4000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if width > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = least * a + np.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    else:
        b = a
    (ha, na), (hb, nb) = cells(a, 2, probes, edge, seed), cells(b, 2, probes, edge, seed)
    met = ((ha == hb) | (na == hb[:, :, None]).any(axis=2) | (nb == ha[:, :, None]).any(axis=2)).mean()
    return int(np.ceil(np.log(MISSED) / np.log(1 - min(met, 1 - MISSED))))


def representatives(vectors: DataFrame) -> DataFrame:
    """(rep, copies, embedding): one row for each distinct usable vector; rep is its smallest vec_id."""
    e = numbers(vectors)
    usable = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding")).where(
        "embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0"
    )
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = usable.where(fine & F.exists("embedding", lambda x: x != 0))
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


ENTRY = "cell long, tab int, part long, rep long, copies long, home boolean, homes array<long>, nears array<long>, embedding "


def linked(reps: DataFrame, least: float = 0.95, tables: int | None = None, probes: int = PROBES, edge: float | None = None, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Counts (rep, links) and a spanning forest (u, v) of the found pairs: rows with the other fields null.

    Vectors sit in their home cell of each table and visit the neighbouring ones. In a cell homes
    meet homes and visitors, and a pair is taken in the first table where it meets and, if each visits
    the other's home there, in the cell of the larger id. Cells over ``block`` vectors are split into
    pairs of blocks, so that one cell is never one task's whole work. Cells get smaller with the number of vectors,
    and tables more, unless both are given.
    """
    found = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    edge = edge or edge_for(found[0])
    tables = tables or tables_for(found[1] or 1, least, probes, edge, seed)
    kind = reps.schema["embedding"].dataType.simpleString()
    entry = ENTRY + kind
    numeric = pa.float32() if kind == "array<float>" else pa.float64()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy()
            for width in np.unique(lengths):
                some = batch.filter(pa.array(lengths == width))
                x = some.column("embedding").flatten().to_numpy().reshape(-1, width)
                home, near = cells(unit(x), tables, probes, edge, seed)
                n = len(x)
                raw = some.column("embedding").cast(pa.list_(numeric))
                homes = pa.FixedSizeListArray.from_arrays(pa.array(home.ravel()), tables).cast(pa.list_(pa.int64()))
                nears = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), tables * probes).cast(pa.list_(pa.int64()))
                for t in range(tables):
                    for k in range(-1, probes):
                        cell = home[:, t] if k < 0 else near[:, t, k]
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(n, t, np.int32)), pa.array(np.zeros(n, np.int64)), some.column("rep"), some.column("copies"), pa.array(np.full(n, k < 0)), homes, nears, raw], [c.split()[0] for c in entry.split(", ")])

    entries = reps.select("rep", "copies", "embedding").mapInArrow(deal, entry)
    keyed = reps.select("rep", "copies", "embedding").mapInArrow(deal, entry).select("cell", "tab").groupBy("cell", "tab").count().where(F.col("count") > block)
    big = written(keyed.select("cell", "tab", F.ceil(F.col("count") / block).cast("int").alias("parts")), "lattice-big")
    if big.count():
        own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        dealt = entries.join(big, ["cell", "tab"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda o: F.struct(F.greatest(o, F.col("own")).alias("a"), F.least(o, F.col("own")).alias("b")))
        dealt = dealt.withColumn("pair", F.explode(pairs))
        entries = dealt.select("cell", "tab", F.shiftleft(F.col("pair.a").cast("long"), 31).bitwiseOR(F.col("pair.b").cast("long")).alias("part"), "rep", "copies", "home", "homes", "nears", "embedding", "own")
    else:
        entries = entries.withColumn("own", F.lit(0))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        t, part = key[1].as_py(), key[2].as_py()
        empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        n = table.num_rows
        if n < 2:
            return empty
        table = table.combine_chunks()
        rep, copies, is_home, own = (table.column(c).to_numpy() for c in ("rep", "copies", "home", "own"))
        if not is_home.any():
            return empty
        homes = table.column("homes").combine_chunks().flatten().to_numpy().reshape(n, tables)
        nears = table.column("nears").combine_chunks().flatten().to_numpy().reshape(n, tables, probes)
        width = table.column("embedding").combine_chunks().value_lengths().to_numpy()
        links = np.zeros(n, np.int64)
        label = np.arange(n)
        across = part >> 31 != part & (1 << 31) - 1
        for size in np.unique(width):
            of = np.flatnonzero(width == size)
            x = unit(np.array(table.column("embedding").take(pa.array(of)).combine_chunks().flatten().to_numpy()).reshape(len(of), size))
            for i in range(0, len(of), 1024):
                a, b = np.nonzero(x[i : i + 1024] @ x.T >= least)
                a, b = of[a + i], of[b]
                ok = (a < b) & (is_home[a] | is_home[b]) & (rep[a] != rep[b])
                if across:
                    ok &= own[a] != own[b]
                a, b = a[ok], b[ok]
                fresh = np.ones(len(a), bool)
                for s in range(t):
                    fresh &= (homes[a, s] != homes[b, s]) & ~(nears[a, s] == homes[b, s][:, None]).any(axis=1) & ~(nears[b, s] == homes[a, s][:, None]).any(axis=1)
                visit = ~(is_home[a] & is_home[b])
                mutual = visit & (nears[a, t] == homes[b, t][:, None]).any(axis=1) & (nears[b, t] == homes[a, t][:, None]).any(axis=1)
                at_home = np.where(is_home[a], rep[a], rep[b])
                fresh &= ~mutual | (at_home == np.maximum(rep[a], rep[b]))
                a, b = a[fresh], b[fresh]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                label = local_labels(n, np.concatenate([np.arange(n), a]), np.concatenate([label, b]))
        some = np.flatnonzero(links)
        tree = np.flatnonzero(label != np.arange(n))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.concat_tables([
            pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "u": none(len(some)), "v": none(len(some))}),
            pa.table({"rep": none(len(tree)), "links": none(len(tree)), "u": pa.array(rep[tree]), "v": pa.array(rep[label[tree]])}),
        ])

    return entries.groupBy("cell", "tab", "part").applyInArrow(meet, "rep long, links long, u long, v long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row (vec_id, embedding).

    Cosines are of doubles; links are pairs found with cosine >= ``least``, and ``n_links`` counts the
    other rows linked directly. Equal vectors are one point with a number of copies, all linked.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of different lengths. Rows with a null vec_id link with nothing and are kept with
    a null component. Rows that repeat a vec_id share its smallest component and the links of their
    own vector. An empty table gives no rows.
    """
    reps = written(representatives(vectors), "lattice-reps")
    found = written(linked(reps, least, **options), "lattice-found")
    roots = components(found.where("u IS NOT NULL").select("u", "v"))
    links = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("long"), numbers(vectors).alias("embedding"))
    out = rows.join(named, (rows.embedding == named.embedding) & rows.vec_id.isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_sum(list_transform(embedding, lambda v: abs(v))) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(n, root) USING KEY (n) AS (SELECT vec_id, vec_id FROM embeddings UNION (SELECT p.j, min(r.root) FROM r JOIN p ON p.i = r.n JOIN recurring.r k ON k.n = p.j WHERE r.root < k.root GROUP BY p.j))
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.root::BIGINT AS component_id, v.vec_id = r.root AS kept FROM embeddings v JOIN r ON r.n = v.vec_id LEFT JOIN (SELECT i, count(*) AS n FROM p GROUP BY i) c ON c.i = v.vec_id
"""
