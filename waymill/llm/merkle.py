"""Merkle manifests of tables: levels built from the leaves up, proofs pushed from the root down.

A tree of each group (language) has up to ``FAN`` children a node; the groups' roots, in the order of their keys, are
the leaves of one more tree, whose root stands for the table. Every level is a table in the shared folder. A proof is a
list of steps (left, right), the digests of a node's siblings on either side, from the leaf to the root: a child's
proof is its own step before its parent's proof, so that one join of children to parents a level writes all proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.llm.common import LOWER, UPPER, ascii_lower, written

FAN = 8
#: The fields of a document's leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
#: Bits that monotonically_increasing_id keeps for the number of a row in its partition.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(field: Column) -> Column:
    """A field as ``bytes:value``, so that no two rows of fields read alike; ``-`` if null."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(docs: DataFrame, fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return digest(*[encoded(changed.get(f, docs[f"`{f}`"])) for f in fields])


def group_key(column: Column) -> Column:
    """A key that sorts as the values do by bytes, with null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of written tables with a column ``g``, numbered from 0 in each group (``pos``) and the size ``n`` of the group.

    Rows are sorted over ranges of (g, order), and a row's place is its number in its partition plus what the
    partitions before hold of its group, so that neither a large group nor the table meets in one task. Rows that
    tie in all of ``order`` are spread by their place in the file and may stand either way.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "_tie").sortWithinPartitions("g", *order, "_tie")
    ranged = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-ranged")
    part = F.shiftright("_at", ROW_BITS)
    counts = ranged.groupBy("g", part.alias("_part")).agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    of_group = W.partitionBy("g")
    before = F.coalesce(F.sum("_m").over(of_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(of_group).alias("n"))
    counts = written(counts, "merkle-counts")
    out = ranged.withColumn("_part", part).join(counts, ["g", "_part"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes (g, pos, n, digest): rows with ``kids``, the digests of their children in order."""
    run = F.expr(f"pos div {FAN}")
    up = nodes.where("n > 1").groupBy("g", run.alias("pos")).agg(F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("_k"))
    kids = F.transform("_k", lambda k: k["digest"])
    return up.select("g", "pos", "n", digest(F.array_join(kids, "")).alias("digest"), kids.alias("kids"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees over placed leaves (g, pos, n, digest, ...), the leaves first, the others each a written table."""
    out = [leaves]
    widest = out[0].agg(F.max("n")).first()[0] or 0
    while widest > 1:
        out.append(written(parents(out[-1]), "merkle-level"))
        widest = -(-widest // FAN)
    return out


def tops(built: list[DataFrame]) -> DataFrame:
    """(g, digest) of the root of each group, at whatever level its tree ends."""
    out = None
    for level in built:
        one = level.where("n = 1").select("g", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def step(kids: Column, i: Column) -> Column:
    """The step of child ``i`` (from 0) among its siblings."""
    side = lambda of: F.array_join(of, "")
    return F.struct(side(F.slice(kids, F.lit(1), i)).alias("left"), side(F.slice(kids, i + 2, F.lit(FAN))).alias("right"))


def pushed(built: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``proof`` and the columns of ``above``: (g, proof, ...) of each group's root.

    From the top level down, the rows of a level meet their parents, and take the step among their siblings before
    the parents' proof. A root that ends at a level takes the proof from above as it is.
    """
    more = [c for c in above.columns if c not in ("g", "proof")]
    at_top = above.select("g", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("array<string>").alias("kids"), "proof", *more)
    upper = None
    for depth in range(len(built) - 1, -1, -1):
        ends = at_top.join(built[depth].where("n = 1").select("g"), "g", "left_semi")
        over = (ends if upper is None else ends.unionByName(upper)).withColumnRenamed("pos", "_run").withColumnRenamed("kids", "_kids").withColumnRenamed("proof", "_proof")
        child = built[depth].withColumn("_run", F.when(F.col("n") > 1, F.expr(f"pos div {FAN}")).otherwise(0).cast("long"))
        own = step(F.col("_kids"), F.expr(f"cast(pos % {FAN} as int)"))
        proof = F.when(F.col("n") > 1, F.concat(F.array(own), "_proof")).otherwise(F.col("_proof")).cast(STEPS)
        upper = child.join(over, ["g", "_run"]).withColumn("proof", proof).drop("_run", "_kids", "_proof")
        if depth:
            upper = written(upper.select("g", "pos", "kids", "proof", *more), "merkle-proofs")
    return upper


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, s: digest(s["left"], node, s["right"]))


@dataclass(frozen=True)
class Manifest:
    """The written levels of the groups' trees (leaves first), and those of the tree over the groups' roots."""

    groups: list[DataFrame]
    table: list[DataFrame]

    def roots(self) -> DataFrame:
        """(g, subroot, root): the root of each group, and that of the table."""
        root = tops(self.table).select(F.col("digest").alias("root"))
        return tops(self.groups).select("g", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root))

    def proofs(self) -> DataFrame:
        """The leaves with subroot, root and proof."""
        none = F.array().cast(STEPS)
        whole = tops(self.table).select("g", none.alias("proof"), F.col("digest").alias("root"))
        of_groups = pushed(self.table, whole).select(F.col("group").alias("g"), "proof", F.col("digest").alias("subroot"), "root")
        return pushed(self.groups, written(of_groups, "merkle-roots"))


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """The tree of leaves (g, digest, ...) in each group by ``order``, and the tree of the groups' roots by key."""
    groups = levels(placed(written(leaves, "merkle-leaves"), order))
    roots = tops(groups).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
    return Manifest(groups, levels(placed(roots, ["group"])))


def lowered(docs: DataFrame) -> Column:
    """A tampered leaf: the text with A-Z lower-cased, every other field as it is."""
    return leaf(docs, text=ascii_lower(docs["text"]))


def verified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, after tampering with some.

    Leaves hold the five fields of FIELDS, whatever other columns there are. Per language they ascend by doc_id (null first, equal ids by
    leaf; rows alike in all fields may change places). Documents whose crc32(decimal doc_id) is a multiple of 3 have
    their text's A-Z lower-cased before they are proven; a null doc_id isn't tampered with. ``proof_sha256`` digests
    the siblings from leaf to root in order. Null fields have an encoding of their own, an empty text is another
    value than null, and texts count whole. An empty table gives no rows.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    narrow = docs.select(group_key(docs["lang"]).alias("g"), docs["doc_id"].cast("long").alias("doc_id"), leaf(docs).alias("digest"), lowered(docs).alias("lowered"))
    narrow = narrow.select("g", "doc_id", "digest", F.when(tampered & (F.col("lowered") != F.col("digest")), F.col("lowered")).alias("shown"))
    proven = manifest(narrow, ["doc_id", "digest"]).proofs()
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("shown", "digest"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Table ct: the 256 steps of crc32 by their rule.
CRC_TABLE_SQL = "ct AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text as SQL, over the table ct."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _encoded_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str = "text") -> str:
    return f"sha256({' || '.join(_encoded_sql(f) for f in FIELDS[:-1])} || {_encoded_sql(text)})"


def _tree_sql(tag: str, leaves: str) -> str:
    """Levels lv, and steps st (g, k, pos, l, r) of all nodes with siblings' runs, over leaves (g, pos, n, digest)."""
    return f"""lv{tag}(k, g, pos, n, digest) AS (SELECT 0, g, pos, n, digest FROM {leaves} UNION ALL SELECT any_value(k) + 1, g, pos // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM lv{tag} WHERE n > 1 GROUP BY g, pos // {FAN}),
rn{tag} AS (SELECT k, g, pos // {FAN} AS run, list(digest ORDER BY pos) AS kids FROM lv{tag} WHERE n > 1 GROUP BY ALL),
st{tag} AS MATERIALIZED (SELECT v.k, v.g, v.pos, array_to_string(kids[1 : pos % {FAN}], '') AS l, array_to_string(kids[pos % {FAN} + 2 : {FAN}], '') AS r FROM lv{tag} v JOIN rn{tag} ON rn{tag}.k = v.k AND rn{tag}.g = v.g AND run = v.pos // {FAN} WHERE n > 1)"""


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql()} AS digest, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered, {crc_sql('doc_id::VARCHAR')} % 3 = 0 AS tampered FROM documents, ct),
lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, digest) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql('', 'lf')},
sb AS MATERIALIZED (SELECT '' AS g, g AS lang, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
{_tree_sql('2', 'sb')},
up AS (SELECT lang, sb.digest AS subroot, list(struct_pack(l := l, r := r) ORDER BY k) FILTER (l IS NOT NULL) AS steps FROM sb LEFT JOIN st2 ON st2.pos = sb.pos // (8 ** k)::BIGINT GROUP BY ALL),
pr AS (SELECT lf.doc_id, lf.g, lf.pos, any_value(lf.digest) AS leaf, any_value(CASE WHEN tampered THEN lowered ELSE lf.digest END) AS shown, list(struct_pack(l := l, r := r) ORDER BY k) FILTER (l IS NOT NULL) AS steps FROM lf LEFT JOIN st ON st.g = lf.g AND st.pos = lf.pos // (8 ** k)::BIGINT GROUP BY ALL),
al AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM lv2 WHERE n = 1) AS root, shown, list_concat(coalesce(pr.steps, []), coalesce(up.steps, [])) AS steps FROM pr JOIN up ON up.lang = pr.g),
fo AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(l := shown, r := ''), steps), lambda a, s: struct_pack(l := sha256(s.l || a.l || s.r), r := '')).l AS folded_root FROM al)
SELECT *, folded_root = root AS verified FROM fo
"""

