"""Operator 11: a manifest of a dataset as a tree of hashes, with a proof for each row.

Rows are leaves, numbered within their group by a range partitioning and the counts of its parts. Nodes are made a block of
256 leaves at a time, and each block's top is a leaf of the next tier, so the tiers are few and no task holds more than a block. All
nodes are one table by coordinates (group, level, place).

Lookups are by coordinates: from its place and its group's size a leaf explodes the places of the siblings that its proof needs,
within its block; a block's top does the same in the next tier. The places join the table of nodes, are put in order by level and
place, and a leaf's proof is its own part, then its block's, and so on up. A node near the root, which every leaf needs, is thus
looked up by the blocks below it, 256 at most, and not by all leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written

#: Nodes under one node, and leaves in one block at most.
ARITY, BLOCK = 2, 256
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_MODULO = 7
_STEPS = "array<struct<left: string, right: string>>"


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 of values, each written as its length in UTF-8, a colon and itself, or as - if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with idx, their place by order (nulls first) within keys, and size, the number of rows of those keys. Ties have any order.

    Rows are dealt by ranges; what is equal in all keys is spread by a row's number. One short row for each part and key has the rows before it.
    """
    spark, names = rows.sparkSession, rows.columns
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *by, "__row").sortWithinPartitions(*by)
    placed = written(dealt.select(*names, F.monotonically_increasing_id().alias("__at")).withColumn("__part", F.shiftright("__at", 33)), "placed")
    parts = placed.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    parts = parts.select(F.col("__part").alias("__of"), *[F.col(k).alias(f"__of_{k}") for k in keys], (before - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy(*keys)).alias("size"))
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return placed.join(parts, same).select(*names, (F.col("__at") + F.col("__shift")).alias("idx"), "size")


class Tree:
    """Trees over leaves (grp long, idx long, size long, hash string), one for each grp: `nodes` and `proofs`."""

    def __init__(self, leaves: DataFrame, arity: int = ARITY):
        if arity < 2:
            raise ValueError("arity must be two or more")
        self.arity, self.depth = arity, max(1, int(math.log(BLOCK, arity) + 1e-9))
        height = F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(arity), k) < F.col("size")))
        tier = leaves.select("grp", "size", height.alias("height"), F.lit(0).alias("level"), "idx", F.unhex("hash").alias("hash"))
        tier = written(tier, "tier")
        self.height = tier.agg(F.max("height")).first()[0] or 0
        tables, base = [tier], 0
        while base < self.height:
            made = written(self._above(tier, base), "nodes")
            tables.append(made)
            base += self.depth
            tier = made.filter((F.col("level") == base) & (F.col("height") > base))
        self.nodes = tables[0]
        for t in tables[1:]:
            self.nodes = self.nodes.unionByName(t)

    def _above(self, tier: DataFrame, base: int) -> DataFrame:
        """Nodes of the levels over one tier's, block by block."""
        a, leaves = self.arity, self.arity**self.depth
        blocks = tier.filter(F.col("height") > base).groupBy("grp", "size", "height", F.expr(f"idx div {leaves}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("low"))

        def over(x: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / a).cast("int")), lambda i: F.sha2(F.array_join(F.slice(x, i * a + 1, F.lit(a)), ""), 256))

        low = F.transform("low", lambda x: F.lower(F.hex(x["hash"])))
        levels = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(self.depth), F.col("height") - base)), F.array(low), lambda done, _: F.concat(done, F.array(over(F.element_at(done, -1)))))
        each = blocks.select("grp", "size", "height", "block", F.posexplode(levels).alias("up", "row")).filter("up > 0")
        place = F.col("block") * F.pow(F.lit(a), self.depth - F.col("up")).cast("long") + F.col("at")
        return each.select("*", F.posexplode("row").alias("at", "node")).select("grp", "size", "height", (F.col("up") + base).alias("level"), place.alias("idx"), F.unhex("node").alias("hash"))

    def tops(self) -> DataFrame:
        return self.nodes.filter("level = height").select("grp", F.lower(F.hex("hash")).alias("top"))

    def proofs(self) -> DataFrame:
        """(grp, idx, steps) of leaves that are no top themselves: what stands left and right of the path at each level, '' if nothing does."""
        a, span = self.arity, self.arity**self.depth
        spots = self.nodes.filter(f"level % {self.depth} = 0 AND level < height").select("grp", "size", F.col("level").alias("base"), "idx", F.least(F.lit(self.depth), F.col("height") - F.col("level")).alias("levels"))
        power = "CAST(pow({0}, {1}) AS BIGINT)"
        own, held = f"idx div {power.format(a, 'k')}", power.format(a, "base + k")
        first = f"({own}) div {a} * {a}"
        wanted = F.expr(f"""flatten(transform(sequence(0, levels - 1), k -> transform(
            filter(sequence({first}, least({first} + {a}, (size + {held} - 1) div {held}) - 1), p -> p <> {own}), p -> named_struct('level', base + k, 'place', p, 'left', p < {own}))))""")
        places = spots.select("grp", "base", "idx", "levels", F.explode_outer(wanted).alias("p")).select("grp", "base", "idx", "levels", "p.*")
        found = places.join(self.nodes.select("grp", "level", F.col("idx").alias("place"), "hash"), ["grp", "level", "place"], "left")
        ordered = F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "place", "left", "hash"))))
        grouped = found.groupBy("grp", "base", "idx").agg(F.first("levels").alias("levels"), ordered.alias("found"))

        def side(k: Column, left: bool) -> Column:
            return F.array_join(F.transform(F.filter("found", lambda s: (s["level"] == k) & (s["left"] == F.lit(left))), lambda s: F.lower(F.hex(s["hash"]))), "")

        steps = F.transform(F.sequence(F.col("base"), F.col("base") + F.col("levels") - 1), lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))
        parts = written(grouped.select("grp", "base", "idx", steps.alias("steps")), "proofs")
        full = None
        for base in reversed(range(0, max(self.height, 1), self.depth)):
            part = parts.filter(F.col("base") == base).select("grp", "idx", "steps")
            if full is not None:
                above = full.select("grp", F.col("idx").alias("block"), F.col("steps").alias("above"))
                part = part.withColumn("block", F.expr(f"idx div {span}")).join(above, ["grp", "block"], "left").select("grp", "idx", F.concat("steps", F.coalesce("above", F.array().cast(_STEPS))).alias("steps"))
            full = part
        return full


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def with_proofs(leaves: DataFrame, group: str, order: str, arity: int = ARITY) -> DataFrame:
    """leaves (with a column leaf, hex text) and subroot, root, steps: a tree for each value of group (null is one) by order and then leaf
    (nulls first), and a tree over their tops by group (null first, bytewise). Equal leaves of one place in the order have any order, which changes
    no row but by exchanging equal ones. An empty table gives no rows.
    """
    names = leaves.columns
    leaves = written(leaves, "leaves")
    groups = numbered(leaves.select(F.col(group).alias("of")).distinct(), [], ["of"])
    groups = written(groups.select("of", F.col("idx").alias("grp"), F.col("size").alias("n_groups")), "groups")
    placed = numbered(leaves, [group], [order, "leaf"])
    placed = written(placed.join(groups, placed[group].eqNullSafe(groups["of"])).drop("of", "n_groups"), "numbered")
    tree = Tree(placed.select("grp", "idx", "size", F.col("leaf").alias("hash")), arity)
    tops = written(tree.tops().join(groups, "grp"), "tops")
    over = Tree(tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.col("n_groups").alias("size"), F.col("top").alias("hash")), arity)
    nothing = F.array().cast(_STEPS)
    upper = tops.select("grp", F.col("top").alias("subroot"), F.lit(0).cast("long").alias("all")).join(over.tops().select(F.col("grp").alias("all"), F.col("top").alias("root")), "all")
    upper = upper.join(over.proofs().select(F.col("idx").alias("grp"), F.col("steps").alias("above")), "grp", "left").select("grp", "subroot", "root", F.coalesce("above", nothing).alias("above"))
    whole = placed.join(tree.proofs(), ["grp", "idx"], "left").join(upper, "grp")
    return whole.select(*names, "subroot", "root", F.concat(F.coalesce("steps", nothing), "above").alias("steps"))


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents; tampered rows fail.

    Null values are written as -. A null doc_id comes first and is never tampered with; repeated doc_ids are leaves each, by their hash. Other columns
    are not read. A table of one row is its own root, with an empty proof.
    """
    plain = [F.col(c) for c in COLUMNS]
    changed = [c + 1 if name == "n_chars" else c for name, c in zip(COLUMNS, plain, strict=True)]
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_MODULO == 0
    leaf = leaf_hash(*plain)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf.alias("leaf"), F.when(tampered, leaf_hash(*changed)).alias("shown"))
    rows = with_proofs(leaves, "lang", "doc_id", arity)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("shown", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)
_CHANGED = _FIELDS.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
#: H over nodes (grp, lev, n, idx, h): one level from the one below, until one node is left.
_UP = "SELECT grp, lev + 1, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY grp, lev, n, idx // 2"
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), hashed AS (
  SELECT doc_id, lang, sha256({_FIELDS}) AS leaf, sha256({_CHANGED}) AS changed,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {TAMPERED_MODULO} = 0 AS tampered
  FROM documents, crc_table
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER () AS id FROM hashed
), nodes AS (
  SELECT grp, 0 AS lev, n, idx, leaf AS h FROM leaves UNION ALL {_UP.format("nodes")}
), tops AS (
  SELECT 0 AS grp, 0 AS lev, count(*) OVER () AS n, grp AS idx, h FROM nodes WHERE n = 1
), high AS (
  SELECT * FROM tops UNION ALL {_UP.format("high")}
), steps AS (
  SELECT id, lev, x.h, x.idx < l.idx // (1 << lev) AS is_left FROM (SELECT *, unnest(range(63)) AS lev FROM leaves) l
    JOIN nodes x USING (grp, lev) WHERE x.idx = xor(l.idx // (1 << lev), 1)
  UNION ALL SELECT id, 100 + lev, x.h, x.idx < l.grp // (1 << lev) FROM (SELECT *, unnest(range(63)) AS lev FROM leaves) l JOIN high x USING (lev) WHERE x.idx = xor(l.grp // (1 << lev), 1)
), proofs AS (
  SELECT id, string_agg(h, '' ORDER BY lev) AS siblings FROM steps GROUP BY id
), path AS (
  SELECT id, lev, n FROM leaves JOIN (SELECT DISTINCT grp, lev, n AS n_here FROM nodes) USING (grp) WHERE n_here > 1
  UNION ALL SELECT id, 100 + lev, 0 FROM leaves, (SELECT DISTINCT lev, n AS n_here FROM high) WHERE n_here > 1
), walk AS (
  SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY p.lev) AS k, coalesce(s.h, '') AS h, coalesce(s.is_left, false) AS is_left FROM path p LEFT JOIN steps s ON s.id = p.id AND s.lev = p.lev
), fold AS (
  SELECT id, 0::BIGINT AS k, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM leaves
  UNION ALL SELECT f.id, w.k, sha256(CASE WHEN w.is_left THEN w.h || f.h ELSE f.h || w.h END) FROM fold f JOIN walk w ON w.id = f.id AND w.k = f.k + 1
)
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN tops t ON t.idx = l.grp JOIN high r ON r.n = 1 LEFT JOIN proofs p ON p.id = l.id JOIN (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id) f ON f.id = l.id
"""
