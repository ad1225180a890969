"""Rows that two patterns of a class share, over tiles of patterns and chunks of cells.

One scan of the cells (compressed by class first) writes the coverage of each tile of patterns over each chunk of cells as bits.
Tiles are then paired by a shuffle on (class, tile, tile, group of chunks); a task multiplies its coverage matrices and emits finished
pairs, of which those that cannot reach the wanted share are never formed as rows. Where a class has more chunks than one
task should hold, groups of chunks give partial sums that are added up before the share is tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.packed import bit_rows, blocks, choice_bits, class_places, coverage_of, listed_patterns, mask_rows, masks_of, packed_patterns
from tidemark.operators.profile import Layout
from tidemark.session import cut

TILE = 1024  # patterns
CELLS = 4096  # cells of a chunk
TOGETHER = 64  # chunks of a class in one task: 2 x 64 x 512 KB of bits at most
SCHEMA = "class string, pos1 bigint, pos2 bigint, both bigint"


def overlap_pairs(cells: DataFrame, patterns: DataFrame, layout: Layout, max_pct: float | None = None) -> DataFrame:
    """(class, pos1, pos2, both): rows of their class that two patterns share, for pos1 < pos2 and both > 0.

    ``patterns``: pos, class, masks. With ``max_pct`` only pairs that share at least this part of the smaller one's rows. The driver holds the
    masks of the patterns, a few numbers each; tasks get them as one broadcast.
    """
    spark = cells.sparkSession
    words = list(layout.words)
    cube = cells.groupBy("class", *words).agg(F.sum("n").alias("n"))
    listed = listed_patterns(patterns, ["pos", "class", "masks"], 1 << 30)
    if listed.num_rows == 0:
        return spark.createDataFrame([], SCHEMA)
    listed = listed.sort_by([("class", "ascending"), ("pos", "ascending")])
    own = packed_patterns(masks_of(listed, layout), listed.column("class").to_pylist(), layout)
    pos = listed.column("pos").to_numpy().astype(np.int64)
    begin = np.searchsorted(own.own, np.arange(len(own.classes) + 1))  # patterns of a class stand together
    sent = spark.sparkContext.broadcast((own, pos, begin))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns_, _, first = sent.value
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for block in blocks(batches, CELLS * 8):
            rows, weight = mask_rows(block, words), block.column("n").to_numpy().astype(np.int64)
            place = class_places(block, patterns_.classes)
            for c, name in enumerate(patterns_.classes):
                at = np.flatnonzero(place == c)
                for start in range(0, len(at), CELLS):
                    some = at[start : start + CELLS]
                    bits = choice_bits(patterns_, rows[some])
                    out = [(t, coverage_of(patterns_, bits, slice(lo, min(lo + TILE, first[c + 1])))) for t, lo in enumerate(range(first[c], first[c + 1], TILE))]
                    out = [(t, covered) for t, covered in out if covered.any()]
                    if out:
                        columns = [
                            [name] * len(out), [t for t, _ in out], [chunk] * len(out), [len(some)] * len(out),
                            [weight[some].tobytes()] * len(out), [covered.tobytes() for _, covered in out],
                        ]
                        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["class", "tile", "chunk", "size", "weight", "bits"]
                        )
                    chunk += 1

    tiles = cut(
        cube.select("class", "n", *words).mapInArrow(cover, "class string, tile int, chunk bigint, size int, weight binary, bits binary")
    )
    most = tiles.groupBy("class", "tile").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = -(-most // TOGETHER)
    counts = {name: -(-int(begin[c + 1] - begin[c]) // TILE) for c, name in enumerate(own.classes)}
    last = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(n - 1))])[F.col("class")]
    partners = F.sequence(F.lit(0), last)
    keyed = (
        tiles.withColumn("other", F.explode(partners))
        .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other"), "part": F.pmod(F.xxhash64("chunk"), F.lit(max(groups, 1)))})
        .drop("other")
    )
    whole = groups <= 1

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        patterns_, places, first = sent.value
        name, a, b = key[0], key[1], key[2]
        c = patterns_.classes.index(name)
        at = [places[first[c] + t * TILE : min(first[c] + (t + 1) * TILE, first[c + 1])] for t in (a, b)]
        total = np.zeros((len(at[0]), len(at[1])))
        alone = [np.zeros(len(x)) for x in at]

        def matrix(row) -> np.ndarray:
            bytes_ = np.frombuffer(row.bits, np.uint8).reshape(-1, -(-row.size // 64) * 8)
            return np.unpackbits(bytes_, axis=1, count=row.size).astype(np.float64)

        for _, rows in pdf.groupby("chunk", sort=False):
            found = {}
            for row in rows.itertuples(index=False):
                if row.tile not in found:
                    found[row.tile] = matrix(row), np.frombuffer(row.weight, np.int64).astype(np.float64)
            for k, t in enumerate((a, b)):
                if t in found:
                    alone[k] += found[t][0] @ found[t][1]
            if a in found and b in found:
                total += (found[a][0] * found[a][1]) @ found[b][0].T
        wanted = (total > 0) & (at[0][:, None] < at[1][None, :])
        if whole and max_pct is not None:  # both patterns' rows are all here; the exact test follows in the filter
            wanted &= total >= max_pct * (1 - 1e-9) * np.minimum(alone[0][:, None], alone[1][None, :])
        i, j = np.nonzero(wanted)
        return pd.DataFrame({"class": name, "pos1": at[0][i], "pos2": at[1][j], "both": total[i, j].astype(np.int64)})

    pairs = keyed.groupBy("class", "a", "b", "part").applyInPandas(multiply, SCHEMA)
    return pairs if whole else pairs.groupBy("class", "pos1", "pos2").agg(F.sum("both").alias("both"))
