"""A Merkle manifest of a table: an external-memory store of nodes, and proofs read from it by coordinate.

A row is a leaf: the SHA-256 of its fields, each ``-`` if null, else byte count, ``:`` and value.
Leaves of a group ascend by key; runs of ``FAN`` nodes become their parents, up to one node, the
group's subroot.  Subroots, in order of the groups (null first, bytewise), become the root in the
same way.  A digest of nodes is the SHA-256 of their lower-case hex texts.

1. Leaf digests are written, range-partitioned and sorted by group and key: the leaf runs.  A
   node's coordinate is its group, level and place; places come from the sizes of the ranges.
2. Each level reads the one below and is written to its own partition of the store; a node keeps
   the digests of its children.  The levels shrink by the factor ``FAN``.
3. Proofs are merge joins of neighbouring levels by coordinate, from the root down: a node's path
   is what stands left and right of it in its run, before its parent's path.

Shuffles carry digests and coordinates, never texts, and every key of them is a coordinate, so
a group that holds most rows is spread as evenly as any other.

Defined cases: null keys come first, rows with one key are ordered by leaf (equal leaves are
interchangeable); every row, repeated or not, is a leaf with a result of its own; a run of one
node still becomes its hash; a null text differs from an empty one; texts of any length are
hashed as they are; other columns are ignored; an empty table has no nodes and no proofs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, table, written

FAN = 8
#: Bytes of a digest.
SIZE = 32
#: ``monotonically_increasing_id`` holds the partition above so many bits.
_ROW_BITS = 33
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(nodes: Column) -> Column:
    """Digest (bytes) of concatenated digests (bytes): SHA-256 of their hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest (bytes) of a row's fields."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def manifest_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"


def write_manifest(docs: DataFrame, path: str, fields: list[str], group: str, key: str, present: dict[str, Column] | None = None) -> None:
    """The store of a table at ``path``: leaf runs, offsets and levels of the groups' trees and of the tree above them.

    ``present`` gives other values of some fields, as they are found now; a leaf then has the
    digest ``seen`` of these beside its own.  Rows where all of them are null are as they were.
    """
    now = [F.coalesce(present[f], F.col(f).cast("string")) if present and f in present else F.col(f) for f in fields]
    changed = F.lit(False) if not present else ~F.coalesce(*[c.cast("string") for c in present.values()], F.lit(None).cast("string")).isNull()
    seen = F.when(changed, leaf_digest(now))
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = written(docs.select(name.alias("grp"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("digest"), seen.alias("seen")), "leaves")
    _write_tree(leaves, f"{path}/groups", [F.col("grp"), F.asc_nulls_first("key"), F.col("digest"), F.asc_nulls_first("seen")])
    discard(leaves)
    spark = docs.sparkSession
    tops = [level.filter("n = 1").select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest") for level in (_leaves(spark, f"{path}/groups"), *_levels(spark, f"{path}/groups"))]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    _write_tree(subroots, f"{path}/above", [F.col("grp"), F.col("key")])


def _write_tree(rows: DataFrame, path: str, order: list[Column]) -> None:
    """Runs, offsets and levels 1, 2, ... of the trees of rows ``grp``, ``digest`` and others, in their order."""
    spark = rows.sparkSession
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs").withColumn("range", F.shiftright("at", _ROW_BITS))
    sizes = runs.groupBy("range", "grp").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("grp").orderBy("range")) - F.col("held")
    sizes.select("range", "grp", "first", before.alias("start"), F.sum("held").over(Window.partitionBy("grp")).alias("n")).write.parquet(f"{path}/offsets")
    most = spark.read.parquet(f"{path}/offsets").agg(F.max("n")).first()[0] or 1
    below, level = _leaves(spark, path), 0
    while most > 1:
        level += 1
        runs = below.filter("n > 1").groupBy("grp", "n", F.shiftright("pos", int(math.log2(FAN))).alias("pos"))
        told = runs.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("nodes"))
        children = F.concat(*[F.coalesce(F.get("nodes", F.lit(i))["digest"], F.lit(b"")) for i in range(FAN)])
        nodes = told.select("grp", F.expr(f"(n + {FAN} - 1) div {FAN}").alias("n"), "pos", children.alias("children"))
        nodes.withColumn("digest", hashed(F.col("children"))).write.parquet(f"{path}/nodes/level={level}")
        most = -(-most // FAN)
        below = spark.read.parquet(f"{path}/nodes/level={level}")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    """The leaf runs with their places (``pos``, from 0) and the size of their group (``n``)."""
    runs = spark.read.parquet(f"{path}/runs").withColumn("range", F.shiftright("at", _ROW_BITS))
    placed = runs.join(spark.read.parquet(f"{path}/offsets"), ["range", "grp"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("start")).drop("range", "at", "first", "start")


def _levels(spark: SparkSession, path: str) -> list[DataFrame]:
    """Levels 1, 2, ... of the store."""
    most = spark.read.parquet(f"{path}/offsets").agg(F.max("n")).first()[0] or 1
    found = []
    while most > 1:
        found.append(spark.read.parquet(f"{path}/nodes/level={len(found) + 1}"))
        most = -(-most // FAN)
    return found


def _with_paths(spark: SparkSession, path: str, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Leaves with ``path``: what stands left and right of them and of each node above, up to the top; ``top`` gives the tops theirs and more columns."""
    levels = [_leaves(spark, path), *_levels(spark, path)]
    above = None
    for nodes in reversed(levels):
        tops = top(nodes.filter("n = 1"))
        if above is None:
            above = tops
            continue
        carried = [c for c in above.columns if c not in ("grp", "pos", "n", "children", "digest")]
        parents = above.select("grp", F.col("pos").alias("parent"), "children", *carried)
        joined = nodes.filter("n > 1").withColumnRenamed("children", "own") if "children" in nodes.columns else nodes.filter("n > 1")
        joined = joined.withColumn("parent", F.shiftright("pos", int(math.log2(FAN)))).join(parents, ["grp", "parent"])
        at = (F.col("pos") % FAN * SIZE).cast("int")
        beside = F.struct(F.substring("children", F.lit(1), at).alias("left"), F.substring("children", at + SIZE + 1, F.lit(FAN * SIZE)).alias("right"))
        joined = joined.withColumn("path", F.concat(F.array(beside), "path")).drop("parent", "children")
        if "own" in joined.columns:
            joined = joined.withColumnRenamed("own", "children")
        above = joined.unionByName(tops)
    return above


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Of every leaf of a store: ``key``, ``leaf``, ``seen``, ``subroot``, ``root`` (bytes) and ``path``, an array of ``left`` and ``right`` from the leaf's run up to the root."""
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    roots = _with_paths(spark, f"{path}/above", lambda tops: tops.withColumn("path", none).withColumn("root", F.col("digest")))
    roots = roots.select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    found = _with_paths(spark, f"{path}/groups", lambda tops: tops.join(roots, "grp"))
    return found.select("key", F.col("digest").alias("leaf"), "seen", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest (bytes) of a path's siblings, level by level, left to right."""
    return hashed(F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, x["left"], x["right"])))


def folded(path: Column, leaf: Column) -> Column:
    """The root (bytes) that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda a, x: hashed(F.concat(x["left"], a, x["right"])))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``; rows whose key's CRC-32 is divisible by 3 are found with the letters A-Z of their text lower-cased."""
    docs = table(spark, sf_dir, "documents")
    path = manifest_path(spark)
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", _UPPER, _LOWER))
    write_manifest(docs, path, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": altered})
    found = proofs(spark, path).withColumn("folded", folded(F.col("path"), F.coalesce("seen", "leaf")))
    shown = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("key").alias("doc_id"), shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        shown(proof_digest(F.col("path"))).alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: Levels and folds as recursions; CRC-32 by a table of 256 entries.
MERKLE_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
    SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
      FROM documents, crc),
l AS (SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(CASE WHEN h % 3 = 0 THEN low ELSE text END) || ':' || CASE WHEN h % 3 = 0 THEN low ELSE text END, '-')) AS seen FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM l),
t(grp, level, n, pos, digest) AS (
    SELECT grp, 0, n, place, leaf FROM p
    UNION ALL SELECT grp, level + 1, (n + 7) // 8, run, digest FROM (SELECT grp, level, n, pos // 8 AS run, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM t WHERE n > 1 GROUP BY grp, level, n, pos // 8)),
s AS (SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
r(level, n, pos, digest) AS (
    SELECT 0, n, place, subroot FROM s
    UNION ALL SELECT level + 1, (n + 7) // 8, run, digest FROM (SELECT level, n, pos // 8 AS run, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM r WHERE n > 1 GROUP BY level, n, pos // 8)),
top AS (SELECT digest AS root FROM r WHERE n = 1),
nodes AS (SELECT grp, level, pos, digest FROM t WHERE n > 1 UNION ALL SELECT s.grp, s.height + r.level, r.pos, r.digest FROM s, r WHERE r.n > 1),
runs AS (SELECT grp, level, pos // 8 AS run, list(digest ORDER BY pos) AS ds FROM nodes GROUP BY ALL),
f(id, grp, place, level, own, cur, told) AS (
    SELECT row_number() OVER (), grp, place, 0, place, seen, '' FROM p
    UNION ALL
    SELECT f.id, f.grp, f.place, f.level + 1, CASE WHEN f.level + 1 = s.height THEN s.place ELSE f.own // 8 END,
           sha256(array_to_string(list_concat(ds[:(f.own % 8)::INT], [cur], ds[(f.own % 8 + 2)::INT:]), '')), told || array_to_string(list_concat(ds[:(f.own % 8)::INT], ds[(f.own % 8 + 2)::INT:]), '')
    FROM (SELECT f.id, f.grp, f.place, f.level, CASE WHEN f.level = 0 AND s0.height = 0 THEN s0.place ELSE f.own END AS own, f.cur, f.told FROM f JOIN s s0 USING (grp)) f
    JOIN s USING (grp) JOIN runs ON runs.grp = f.grp AND runs.level = f.level AND runs.run = f.own // 8),
done AS (SELECT id, grp, place, arg_max(cur, level) AS folded_root, arg_max(told, level) AS told FROM f GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(done.told) AS proof_sha256, done.folded_root, done.folded_root = top.root AS verified
FROM p JOIN done ON p.grp = done.grp AND p.place = done.place JOIN s ON s.grp = p.grp, top"""
