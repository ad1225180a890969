"""Suffix-array dedup (operator 3): a sparse suffix array over minimiser positions, matches extended left and right.

Of every ``WINDOW`` consecutive word k-grams of a text the one with the least hash is retained, so equal passages retain
equal positions, and any common passage of K + WINDOW - 1 = 49 words holds a retained position with its whole k-gram.
Retained suffixes whose k-gram stands in two documents are sorted twice over the cluster, by k-gram and what follows it and
by k-gram and what precedes it, and compared with their neighbours of other documents. Each comparison extends
over the carried context on both sides; extensions of one diagonal overlap and are joined to whole matches.

The sort is by range over all columns, so a passage that a third of the documents share is spread over tasks, and each
suffix meets its neighbours only: the work is linear in the suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import components, flat_lists, hashes, mix, slices, table, words
from tidemark.session import cut, scratch_path

K = 25
WINDOW = 25
#: Words of context carried on either side: more than the largest distance of retained positions, so that the
#: extensions of neighbouring positions of one match always overlap.
CONTEXT = 32
#: Bytes of a word's hash in a context.
WIDTH = 3


def _gram_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, built from those of 1, 2, 4, ... words."""
    part, size, out, done = flat.view(np.uint64), 1, None, 0
    while True:
        if k & size:
            take = part if out is None else mix(out[: max(len(part) - done, 0)] + part[done:] * np.uint64(0x9E3779B97F4A7C15))
            out, done = take, done + size
        if size * 2 > k:
            return out[: max(len(flat) - k + 1, 0)]
        part = mix(part[:-size] * np.uint64(0xD6E8FEB86659FD93) + part[size:]) if len(part) > size else part[:0]
        size *= 2


def retained(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of window minima (the first of equal ones). In a run of one repeated k-gram, where every position would be
    one, those stay that lie a multiple of ``window`` behind the run's start, and the run's last."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    begins = np.concatenate([[True], grams[1:] != grams[:-1]])
    start = np.maximum.accumulate(np.where(begins, np.arange(len(grams)), 0))
    ends = np.concatenate([begins[1:], [True]]) & ~begins
    return np.union1d(at[(at - start[at]) % window == 0], np.flatnonzero(ends))


def _suffixes(hashed: DataFrame) -> DataFrame:
    """(doc_id, pos, gram) of the retained positions."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat, offsets = flat_lists(batch.column(1))
            grams = _gram_hashes(flat, K)
            row, pos, name = [], [], []
            for r in np.flatnonzero(np.diff(offsets) >= K + WINDOW - 1):
                own = grams[offsets[r] : offsets[r + 1] - K + 1]
                at = retained(own)
                row.append(np.full(len(at), r))
                pos.append(at)
                name.append(own[at])
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(name).view(np.int64))],
                    ["doc_id", "pos", "gram"],
                )

    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(emit, f"doc_id {kind}, pos int, gram bigint")


def _contexts(wanted: DataFrame) -> DataFrame:
    """(gram, doc_id, pos, before, after): the words before a position, nearest first, and those after its k-gram."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat, offsets = flat_lists(batch.column(1))
            small = flat.astype(">i4").view(np.uint8).reshape(-1, 4)[:, :WIDTH]
            rows: list[list] = [[], [], [], []]
            number = []
            for r, places in enumerate(batch.column(2)):
                own = small[offsets[r] : offsets[r + 1]]
                ahead, back = own.tobytes(), own[::-1].tobytes()
                n = len(own)
                for x in places.as_py():
                    pos = x["pos"]
                    number.append(r)
                    rows[0].append(x["gram"])
                    rows[1].append(pos)
                    rows[2].append(back[(n - pos) * WIDTH : (n - pos + CONTEXT) * WIDTH])
                    rows[3].append(ahead[(pos + K) * WIDTH : (pos + K + CONTEXT) * WIDTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), batch.column(0).take(pa.array(number, pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
                ["gram", "doc_id", "pos", "before", "after"],
            )

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(emit, f"gram bigint, doc_id {kind}, pos int, before binary, after binary")


def _common_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def _match(a: tuple, b: tuple) -> tuple:
    """(doc_a, doc_b, diagonal, begin, end) in words of the smaller document, of two rows (gram, doc_id, pos, before, after)."""
    if b[1] < a[1]:
        a, b = b, a
    left, right = _common_words(a[3], b[3]), _common_words(a[4], b[4])
    return a[1], b[1], b[2] - a[2], a[2] - left, a[2] + K + right


def neighbours(rows: Iterator[tuple], boundary: list[tuple] | None = None) -> Iterator[tuple]:
    """Matches of sorted rows with the nearest row before and after them of the same k-gram and another document.

    ``boundary`` collects the first and the last row. Held at any time: one document's rows of one k-gram and the row before them.
    """
    before = first = None
    run: list[tuple] = []
    for row in rows:
        first = first or row
        if run and row[0] != run[-1][0]:
            before, run = None, []
        elif run and row[1] != run[-1][1]:
            before = run[-1]
            yield from (_match(earlier, row) for earlier in run[:-1])
            run = []
        if before is not None:
            yield _match(before, row)
        run.append(row)
    if boundary is not None and run:
        boundary += [first, run[-1]]


def _compared(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """(doc_a, doc_b, diagonal, begin, end) of neighbours in the given order of (gram, one side, other side)."""
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    columns = ["gram", "doc_id", "pos", "before", "after"]
    keys = ["gram", *order, "doc_id", "pos"]
    ranged = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns, F.spark_partition_id().alias("task"))
    names = ["doc_a", "doc_b", "diagonal", "begin", "end"]
    id_kind = to_arrow_type(suffixes.schema["doc_id"].dataType)
    edge_kind = pa.struct(
        [("task", pa.int32()), ("gram", pa.int64()), ("doc_id", id_kind), ("pos", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = [0]

        def stream() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    task[0] = batch.column(5)[0].as_py()
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

        def packed(found: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
            parts = list(zip(*found, strict=True)) or [()] * 5
            pad = [None] * len(ends)
            kinds = [id_kind, id_kind, pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array([*p, *pad], k) for p, k in zip(parts, kinds, strict=True)]
            edge = [None] * len(found) + [dict(zip(("task", *columns), (task[0], *e), strict=True)) for e in ends]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(edge, edge_kind)], [*names, "edge"])

        found: list[tuple] = []
        ends: list[tuple] = []
        for m in neighbours(stream(), ends):
            found.append(m)
            if len(found) == 50_000:
                yield packed(found, [])
                found = []
        yield packed(found, ends)

    schema = f"doc_a {kind}, doc_b {kind}, diagonal int, begin int, end int, edge struct<task:int,gram:bigint,doc_id:{kind},pos:int,before:binary,after:binary>"
    got = cut(ranged.mapInArrow(compare, schema))
    # Neighbours that lie in different tasks: the last row of one and the first of the next, two small rows a task.
    edges = sorted((r["edge"] for r in got.where("edge IS NOT NULL").select("edge").collect()), key=lambda e: e["task"])
    rows = [tuple(e[c] for c in columns) for e in edges]
    extra = list(neighbours(iter(rows)))
    more = suffixes.sparkSession.createDataFrame(extra, f"doc_a {kind}, doc_b {kind}, diagonal int, begin int, end int")
    return got.where("doc_a IS NOT NULL").drop("edge").unionByName(more)


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b, n_words): equal stretches of at least ``min_words`` (49 or more) words.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs outside whitespace, as they stand. Each document's
    repeated passages are matched with those of its neighbours in the suffix orders, not with every document that holds them, so
    the result is linear in the input; doc_a < doc_b. A stretch is as long as the two are neighbours along it, so it may be part
    of a longer equal one whose rest is matched with another document. Null, empty and shorter texts have no rows, nor have
    rows with a null doc_id. Equal rows are one; different texts under one doc_id count as one document's. Repeats within
    one document are not reported. An empty table gives an empty result.
    """
    if min_words < K + WINDOW - 1:
        raise ValueError(f"min_words must be at least {K + WINDOW - 1}")
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", hashes(words(F.col("text"))).alias("h"))
    # Written as a table, small beside the texts, since it is read twice.
    path = scratch_path(docs.sparkSession, "suffixes")
    _suffixes(hashed.where(F.size("h") >= min_words)).write.option("compression", "zstd").parquet(path)
    suffixes = docs.sparkSession.read.parquet(path)
    # Written out, so that the join below stands alone and adaptive execution can split a k-gram of very many documents.
    shared = cut(suffixes.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram"))
    wanted = suffixes.join(shared, "gram").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "gram")).alias("places"))  # one document's
    short = hashed.where(F.size("h") >= min_words).select("doc_id", F.transform("h", lambda x: F.shiftright(x, 32).cast("int")).alias("h"))
    chosen = cut(_contexts(short.join(wanted, "doc_id").select("doc_id", "h", "places")))
    found = _compared(chosen, ["after", "before"]).unionByName(_compared(chosen, ["before", "after"]))
    # Stretches of one diagonal: a diagonal belongs to two documents, so its stretches are bounded by their length.
    diagonals = found.groupBy("doc_a", "doc_b", "diagonal").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("parts"))

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, begin, size = [], [], []
            for r, parts in enumerate(batch.column(3).to_pylist()):
                low, high = parts[0]["begin"], parts[0]["end"]
                for p in [*parts[1:], {"begin": 1 << 40, "end": 0}]:
                    if p["begin"] <= high:
                        high = max(high, p["end"])
                        continue
                    if high - low >= min_words:
                        number.append(r)
                        begin.append(low)
                        size.append(high - low)
                    low, high = p["begin"], p["end"]
            pick = pa.array(number, pa.int64())
            diagonal = np.asarray(batch.column(2).take(pick)).astype(np.int64)
            start = np.array(begin, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), pa.array(start), batch.column(1).take(pick), pa.array(start + diagonal), pa.array(size, pa.int64())],
                ["doc_a", "start_a", "doc_b", "start_b", "n_words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return diagonals.mapInArrow(join_parts, f"doc_a {kind}, start_a bigint, doc_b {kind}, start_b bigint, n_words bigint")


def repeated_spans(passages: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, other_doc, n_others, class_id): the words of each document that stand in its ``passages``, as disjoint
    spans, with the smallest of the documents matched there and the number of matches.

    Spans that a passage matches are linked, and a class is all that links reach: every holder of a passage, though each meets its
    neighbours only. class_id is the smallest document with a span in the class, so all but the spans of that document
    are copies. Overlapping passages of a document are one span, so passages that overlap somewhere share a class.
    One document's matches are held at a time, never a class.
    """
    numbered = cut(passages.withColumn("pair", F.monotonically_increasing_id()))
    sides = numbered.select(
        F.explode(
            F.array(
                F.struct(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("start"), "n_words", F.col("doc_b").alias("other"), "pair", F.lit(0).alias("side")),
                F.struct(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("start"), "n_words", F.col("doc_a").alias("other"), "pair", F.lit(1).alias("side")),
            )
        ).alias("m")
    ).select("m.*")
    own = Window.partitionBy("doc_id").orderBy("start", "n_words", "other", "pair", "side")
    far = F.max(F.col("start") + F.col("n_words")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = sides.withColumn("fresh", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(own))
    # A side of a pair lies in one span, so the first one names it.
    named = cut(marked.withColumn("node", F.min(2 * F.col("pair") + F.col("side")).over(Window.partitionBy("doc_id", "span"))))
    spans = named.groupBy("node").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), (F.max(F.col("start") + F.col("n_words")) - F.min("start")).alias("n_words"),
        F.min("other").alias("other_doc"), F.count(F.lit(1)).alias("n_others"),
    )
    links = named.groupBy("pair").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    placed = cut(spans.join(components(links), "node"))  # every span has a match, so all are among the nodes
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "component").select("doc_id", "start", "n_words", "other_doc", "n_others", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(repeated_passages(table(spark, sf_dir, "documents")))
