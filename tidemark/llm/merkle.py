"""Merkle dataset manifest (operator 11): checkpoint and recompute.

A tree of pairwise SHA-256 digests over the rows of each language, and one more tree over the languages' roots. Only every
``STEP``-th level is written: a stored row is an aligned block of at most 2^STEP consecutive nodes of such a level, and its
digest is one node of the next stored level. The levels in between are never kept. Proof extraction goes down from
the root: it regenerates a block's missing nodes from the stored ones, emits the siblings of each of its nodes, puts the
path of the block's parent behind them, and forgets the nodes again.

Rows are placed by a range sort on (language, id, digest) with an identity of their own as the last key, so neither a
language nor an id with a third of all rows meets in one task. A block has at most 64 nodes, whatever the data.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, let, table
from tidemark.operators.rowindex import with_row_index
from tidemark.session import cut, scratch_path

STEP = 6  # levels from one stored level to the next
WIDTH = 1 << STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a proof: the sibling's digest (null: the node is alone in its run) and whether it stands on the left.
PATH = "array<struct<digest:string,left:boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts written one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon, and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(**changed: Column) -> Column:
    """Digest of a row of ``documents``; ``changed`` puts other values in the place of columns."""
    return digest(*[encoded(changed.get(c, F.col(c))) for c in FIELDS])


def _parents(nodes: Column) -> Column:
    """The level above: digests of every two consecutive nodes, the last one alone where their number is odd."""
    at = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(at, lambda i: digest(nodes[i * 2], F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))


def _levels(nodes: Column, depth: Column) -> Column:
    """All levels of a block, its nodes first; levels above ``depth`` repeat the one below them."""

    def grow(levels: Column, above: int) -> Column:
        if above > STEP:
            return levels
        top = F.element_at(levels, -1)
        return let(F.concat(levels, F.array(F.when(depth >= above, _parents(top)).otherwise(top))), lambda more: grow(more, above + 1))

    return grow(F.array(nodes), 1)


def _siblings(levels: Column, at: Column, depth: Column) -> Column:
    """Proof steps of node ``at`` of a block, from the bottom to the block's own digest."""

    def step(level: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(2), level)).cast("int")
        beside = F.when(place % 2 == 0, place + 1).otherwise(place - 1)
        return F.struct(F.get(levels[level], beside).alias("digest"), (place % 2 == 1).alias("left"))

    return F.when(depth == 0, F.array().cast(PATH)).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(depth, F.lit(1)) - 1), step)
    )


def _depth(width: Column) -> Column:
    """Levels inside a block of a level with ``width`` nodes: up to the root, at most ``STEP``."""
    out = F.lit(STEP)
    for d in range(STEP - 1, -1, -1):
        out = F.when(width <= 1 << d, F.lit(d)).otherwise(out)
    return out


class Forest(NamedTuple):
    """Stored levels from the bottom up, and (tree, root) of every tree."""

    stored: list[DataFrame]  # tree, block, width, nodes array<struct<pos, digest, ...>> in order
    roots: DataFrame


def build(nodes: DataFrame, widest: int) -> Forest:
    """Trees over ``nodes`` (tree, pos counted from 0, width: nodes of the tree, digest, other columns stay with the node).

    ``widest`` is the largest width. Each stored level is a table in the shared folder, read back by the next step.
    """
    spark = nodes.sparkSession
    stored, roots = [], []
    level = nodes
    while True:
        members = F.struct("pos", "digest", *[c for c in level.columns if c not in ("tree", "pos", "width", "digest")])
        path = scratch_path(spark, f"merkle-level-{len(stored) * STEP}")
        (
            level.groupBy("tree", F.floor(F.col("pos") / WIDTH).cast("bigint").alias("block"), "width")
            .agg(F.array_sort(F.collect_list(members), lambda a, b: F.signum(a["pos"] - b["pos"]).cast("int")).alias("nodes"))
            .write.parquet(path)
        )
        kept = spark.read.parquet(path)
        stored.append(kept)
        above = kept.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("width") / WIDTH).cast("bigint").alias("above"), "width",
            F.element_at(_levels(F.transform("nodes", lambda x: x["digest"]), _depth(F.col("width"))), -1)[0].alias("digest"),
        )
        roots.append(above.where(F.col("width") <= WIDTH).select("tree", F.col("digest").alias("root")))
        if widest <= WIDTH:
            break
        widest = -(-widest // WIDTH)
        level = above.where(F.col("width") > WIDTH).select("tree", "pos", F.col("above").alias("width"), "digest")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(stored, out)


def proofs(forest: Forest, tops: DataFrame) -> DataFrame:
    """Every bottom node with its proof: ``tops`` (tree, path, other columns) gives what follows after each tree's root.

    Returns tree, pos, the node's columns, those of ``tops``, and path, from the node up to the last step of ``tops``.
    """
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    below = None
    for level in reversed(forest.stored):
        ends = tops.select("tree", F.lit(0).cast("bigint").alias("block"), F.col("path").alias("up"), *carried)
        rooted = level.where(F.col("width") <= WIDTH).join(ends.hint("merge"), ["tree", "block"])
        if below is not None:
            inner = below.select("tree", F.col("pos").alias("block"), F.col("path").alias("up"), *carried)
            rooted = rooted.unionByName(level.where(F.col("width") > WIDTH).join(inner.hint("merge"), ["tree", "block"]))
        depth = _depth(F.col("width"))
        nodes = let(
            _levels(F.transform("nodes", lambda x: x["digest"]), depth),
            lambda levels: F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(_siblings(levels, i, depth), F.col("up")).alias("path"))),
        )
        below = rooted.select("tree", F.explode(nodes).alias("one"), *carried).select("tree", "one.node.*", *carried, "one.path")
    return below


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give."""
    return F.aggregate(
        path, start, lambda acc, s: F.when(s["digest"].isNull(), digest(acc)).when(s["left"], digest(s["digest"], acc)).otherwise(digest(acc, s["digest"]))
    )


class Manifest(NamedTuple):
    rows: Forest  # a tree per language
    langs: Forest  # the tree over their roots
    names: DataFrame  # tree, lang, width, root: one row per language
    root: str | None


def manifest(leaves: DataFrame) -> Manifest:
    """Stored levels of ``leaves`` (lang, doc_id, digest; other columns stay with the leaf).

    Leaves of a language ascend by doc_id, nulls first; rows that repeat a doc_id follow each other by digest, and equal ones
    are leaves of their own. Languages ascend by their UTF-8 bytes, null first. An empty table has no tree and no root.
    """
    spark = leaves.sparkSession
    known = cut(leaves.select("*", F.monotonically_increasing_id().alias("__row")))
    placed = with_row_index(known, ["lang", "doc_id", "digest", "__row"], "__at").drop("__row")
    spans = placed.groupBy("lang").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("width"))
    names = cut(with_row_index(spans, ["lang"], "tree"))
    size = names.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("widest")).first()
    own = F.col("l.lang").eqNullSafe(F.col("t.lang"))
    joined = placed.alias("l").join(names.alias("t"), own)
    payload = [F.col(f"l.{c}") for c in leaves.columns if c != "lang"]
    rows = build(joined.select("t.tree", (F.col("__at") - F.col("__from")).alias("pos"), "t.width", *payload), size["widest"] or 0)
    subroots = cut(rows.roots)
    over = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(size["n"]).cast("bigint").alias("width"), F.col("root").alias("digest"))
    langs = build(over, size["n"])
    top = langs.roots.first()
    return Manifest(rows, langs, names.drop("__from").join(subroots, "tree"), top["root"] if top else None)


def leaf_proofs(kept: Manifest) -> DataFrame:
    """Every leaf with its columns, ``subroot``, ``root`` and ``path`` from the leaf to the root."""
    spark = kept.names.sparkSession
    end = spark.createDataFrame([(0, [])], f"tree bigint, path {PATH}")
    tops = proofs(kept.langs, end).select(F.col("pos").alias("tree"), "path", F.col("digest").alias("subroot"), F.lit(kept.root).cast("string").alias("root"))
    return proofs(kept.rows, cut(tops)).drop("tree", "pos")


def tampered(doc_id: Column) -> Column:
    """Whether the tamper test changes the row: 7 divides the CRC-32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Tamper test over all rows of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    (doc_id, leaf, subroot, root, path, folded_root, verified): the proof is that of the untampered rows, the folded
    root starts from the row as it is found, which for ``tampered`` ids has n_chars + 1. Any column may be null; a null n_chars stays
    null, so such a row is verified. Repeated rows have proofs of their own. An empty table gives an empty result.
    """
    found = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), row_digest(n_chars=F.col("n_chars") + 1))
    leaves = docs.select("lang", "doc_id", row_digest().alias("digest"), found.alias("found"))
    folded = fold(F.coalesce("found", "digest"), F.col("path"))
    out = leaf_proofs(manifest(leaves)).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    siblings = F.array_join(F.transform("path", lambda s: F.coalesce(s["digest"], F.lit(""))), "")
    return verified_manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified"
    )


def _encoded_sql(**changed: str) -> str:
    values = [f"({changed.get(c, c)})::VARCHAR" for c in FIELDS]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


ORACLE = f"""
WITH RECURSIVE read AS (
  SELECT doc_id, lang, sha256({_encoded_sql()}) AS leaf, {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL AS hit, sha256({_encoded_sql(n_chars="n_chars + 1")}) AS found
  FROM documents
), leaves AS (
  SELECT doc_id, leaf, CASE WHEN hit THEN found ELSE leaf END AS start, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM read
), nodes(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1
), tops(level, pos, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), inner_walk(doc_id, leaf, tree, level, pos, n, siblings, acc) AS (
  SELECT doc_id, leaf, tree, 0, pos, n, '', start FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.siblings || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.acc ELSE w.acc || coalesce(s.h, '') END)
  FROM inner_walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
), outer_walk(doc_id, leaf, tree, level, pos, n, siblings, acc) AS (
  SELECT doc_id, leaf, tree, 0, tree, (SELECT count(*) FROM subroots), siblings, acc FROM inner_walk WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.siblings || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.acc ELSE w.acc || coalesce(s.h, '') END)
  FROM outer_walk w LEFT JOIN tops s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, h AS root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = h AS verified
FROM outer_walk w JOIN subroots USING (tree) JOIN tops t ON t.n = 1
WHERE w.n = 1
"""
