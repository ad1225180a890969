"""Text helpers shared by the corpus operators: reading, words, let-bindings, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
#: Links that one task joins to components; more are contracted first.
HELD = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII string expression (Spark has a function for it)."""
    shifts = "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda acc, b: {shifts}), 4294967295)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once even where lambdas inside ``body`` refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged (``lower`` alone would also change accented letters)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs outside [\\x20\\x09-\\x0D]; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words of a flat array; the last n - 1 positions have none."""
    flat = word_hashes.view(np.uint64)
    if len(flat) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(flat) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + flat[i : i + len(out)] + np.uint64(i + 1))
    return out


def slices(batches: Iterator[pa.RecordBatch], column: int, items: int = 1 << 20, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece's list column holds about ``items`` entries (a longer list is a piece of its own) and
    has at most ``rows`` rows: bounds the memory of what is computed from a piece."""
    for batch in batches:
        offsets = np.asarray(batch.column(column).offsets)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + items, side="right")) - 1
            end = min(max(end, begin + 1), begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all lists and the offsets of each list among them."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def least_names(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node that the links (a, b) reach."""
    name = np.arange(n)
    while True:
        x, y = name[a], name[b]
        if (x == y).all():
            return name
        np.minimum.at(name, np.maximum(x, y), np.minimum(x, y))
        while (name[name] != name).any():
            name = name[name]


def _joined(links: DataFrame) -> DataFrame:
    """(node, component) of at most ``HELD`` links."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held)
        ends = pa.chunked_array([*got.column(0).chunks, *got.column(1).chunks])
        nodes = ends.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(got.column(i), nodes).to_numpy() for i in range(2))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least_names(a, b, len(nodes))))], ["node", "component"])

    kind = links.schema["node"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(emit, f"node {kind}, component {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``links``; a component is named by its smallest node.

    Randomised contraction: each round every node moves to that one of itself and its neighbours which has the least hash,
    drawn anew each round, and the links between different new nodes are the next round's links. Chains, stars and
    dense groups alike lose a constant share of their nodes a round, so the rounds are few and their sizes a falling series.
    What is left when ``HELD`` links remain is joined in one task. Moves are aggregated before they are shuffled, so a node with
    very many links costs no single task more than its partial minima.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("peer")).where("node <> peer")
    moves: list[DataFrame] = []
    while True:
        seen = Observation()
        once = cut(both.select(F.least("node", "peer").alias("node"), F.greatest("node", "peer").alias("peer")).distinct().observe(seen, F.count(F.lit(1)).alias("n")))
        if seen.get["n"] <= HELD:
            break
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("draw"), F.col(c).alias("to"))
        ends = once.unionByName(once.select(F.col("peer").alias("node"), F.col("node").alias("peer")))
        moved = cut(ends.groupBy("node").agg(F.min(drawn("peer")).alias("other")).select("node", F.least(drawn("node"), "other")["to"].alias("to")))
        moves.append(moved)
        both = (
            once.join(moved, "node").select("peer", F.col("to").alias("x")).join(moved.toDF("peer", "y"), "peer")
            .where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("peer"))
        )
    if not moves:
        return cut(_joined(once))
    labels = cut(_joined(once))
    for moved in reversed(moves):
        # A node whose links are all inside one new node has no link any more: that node is its component.
        further = labels.select(F.col("node").alias("to"), "component")
        labels = moved.join(further, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    labels = cut(labels)
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
