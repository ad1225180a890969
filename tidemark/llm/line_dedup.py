"""Line deduplication (operator 7): range-partitioned line hashes, first occurrences, keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, WHITE, ascii_lower, let, table
from tidemark.session import cut

#: A key with more than this share of all lines is resolved by a pre-aggregated minimum instead of the sort.
HOT_SHARE = 1 / 512


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_id, pos) of every line with a key; two independent 64-bit hashes name a key."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "text_id", "pos", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "text_id", "pos"
    )


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_id, pos) of each line whose key also stands in a document with a smaller id.

    Line keys are range-partitioned by hash and sorted by document and position, so that each task streams
    over its keys and takes the first document of each. A key that holds more than ``HOT_SHARE`` of all lines
    (found by a heavy-hitter sketch; there can be at most 1 / HOT_SHARE) would fill one range; its first
    document is the minimum of per-task minima, a table of at most that many rows, which is broadcast.
    Both ways give the same answer for any key, so the sketch decides the plan only.
    """
    keys = cut(_line_keys(docs, min_chars))
    limit = max(int(1 / HOT_SHARE), 1)
    top = keys.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {limit}, {8 * limit})").alias("top")
    ).first()
    hot = [t["item"] for t in top["top"] or [] if t["count"] > top["n"] * HOT_SHARE]
    is_hot = F.col("h1").isin(hot)
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    streamed = (
        keys.where(~is_hot)
        .repartitionByRange("h1", "h2")
        .withColumn("first_doc", F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    heads = keys.where(is_hot).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    frequent = keys.where(is_hot).join(F.broadcast(heads), ["h1", "h2"]).select(*streamed.columns)
    return streamed.unionByName(frequent).where("doc_id > first_doc").select("doc_id", "text_id", "pos")


def drop_runs(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: (doc_id, text_id, runs), runs being [start, length] of dropped stretches."""
    gathered = (
        dropped_lines(docs, min_chars)
        .groupBy("doc_id", "text_id")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))  # a document's own lines
    )

    def runs(gone: Column) -> Column:
        starts = F.filter(gone, lambda p, i: F.coalesce(F.get(gone, i - 1) != p - 1, F.lit(True)))
        ends = F.filter(gone, lambda p, i: F.coalesce(F.get(gone, i + 1) != p + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))

    return gathered.select("doc_id", "text_id", let(F.col("gone"), runs).alias("runs"))


def _keep(n_lines: Column, runs: Column) -> Column:
    """Alternating lengths of kept and dropped stretches, a kept one (perhaps of length 0) first."""

    def build(r: Column) -> Column:
        pairs = F.transform(
            r,
            lambda x, i: F.array(
                x["start"] - F.coalesce(F.get(r, i - 1)["start"] + F.get(r, i - 1)["length"], F.lit(0)), x["length"]
            ),
        )
        last = F.get(r, F.size(r) - 1)
        rest = n_lines - last["start"] - last["length"]
        return F.concat(F.flatten(pairs), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))

    return F.when(runs.isNull(), F.array(n_lines)).otherwise(let(runs, build))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The operator's result: (doc_id, text_id, n_lines, keep), a run-length-compressed bitmap per document.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is one empty line. Rows
    with a null doc_id keep all lines. Rows that repeat a doc_id count as one document; ``text_id`` (a hash of the
    text) tells them apart. Keys shorter than ``min_chars`` code points are never dropped.
    """
    every = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.size(_lines(F.col("text"))).alias("n_lines")).distinct()
    return every.join(drop_runs(docs, min_chars), ["doc_id", "text_id"], "left").select(
        "doc_id", "text_id", "n_lines", _keep(F.col("n_lines"), F.col("runs")).alias("keep")
    )


def kept_text(text: Column, keep: Column) -> Column:
    """Apply a bitmap: the kept lines, joined again."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.filter(F.arrays_zip(_lines(text).alias("line"), flags.alias("flag")), lambda x: x["flag"])
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def deduplicated(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(row, n_lines, keep) per row of ``docs``: the row as a struct and its bitmap (null: nothing is dropped). One shuffle of
    the texts by document."""
    runs = drop_runs(docs, min_chars)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_id"), F.size(_lines(F.col("text"))).alias("n_lines")
    )
    joined = rows.join(runs, ["doc_id", "text_id"], "left")
    return joined.select("row", "n_lines", F.when(F.col("runs").isNotNull(), _keep(F.col("n_lines"), F.col("runs"))).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate(F.transform("keep", lambda n, i: F.when(i % 2 == 1, n).otherwise(0)), F.lit(0), lambda s, n: s + n)
    kept = F.when(F.col("keep").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(kept_text(F.col("row.text"), F.col("keep")))
    return marked.select(
        "row.doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keys AS (SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, coalesce(l.doc_id <> keys.first_doc, false) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
