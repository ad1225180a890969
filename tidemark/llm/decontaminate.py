"""Benchmark decontamination (operator 5): rare n-gram seeds, then Smith-Waterman alignment of passages and items.

The first pass over the corpus counts in how many different contexts each n-gram of a test item stands: the ``AROUND`` words
before it and those after it, of which the smaller count is taken. Copies repeat the context on one side at least, so they do
not make an item's own n-grams frequent, as counts of documents would; an everyday phrase has as many contexts as uses. An
item's seeds are its n-grams with at most ``EVERYDAY`` times the item's median number of contexts: always half of them or
more, whatever the size of the corpus. Where copies are edited in many ways, the median grows with their contexts.
The second pass cuts out the passages around seeds, in tiles bounded by the length of the items that the seeds belong to.
Pairs with too few common words to reach the threshold are not aligned; equal passages are aligned with an item once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat_lists, gram_hashes, hashes, let, mix, slices, table
from tidemark.session import cut

#: Items are taken in blocks of about this many words, so that the n-grams and reaches sent to every task stay below 32 MB.
BLOCK_WORDS = 2_000_000
#: An n-gram with more contexts than this many times its item's median is no seed.
EVERYDAY = 8
#: Words on either side of an n-gram that make its context.
AROUND = 8
#: Passage words that are aligned together.
SWEEP_WORDS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def _grams_of(words_hash: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in the flat array, hash) of the n-grams that lie inside one row."""
    grams = gram_hashes(words_hash, n)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(grams)) + n <= row_end[: len(grams)])
    return at, grams[at]


def _hits(batch_lists: pa.Array, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat word hashes, row offsets, positions of known n-grams, their places in ``known``) of a column of hash lists."""
    flat, offsets = flat_lists(batch_lists)
    at, got = _grams_of(flat, offsets, n)
    slot = np.minimum(np.searchsorted(known, got), max(len(known) - 1, 0))
    hit = known[slot] == got if len(known) else np.zeros(len(got), bool)
    return flat, offsets, at[hit], slot[hit]


def _context_counts(lists: DataFrame, known: np.ndarray, n: int) -> DataFrame:
    """(gram, contexts): the smaller number of different words before, or after, each known n-gram in the hash lists ``h``."""
    sent = lists.sparkSession.sparkContext.broadcast(known)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            flat, offsets, at, slot = _hits(batch.column(0), sent.value, n)
            if not len(at):
                continue
            words = flat.view(np.uint64)
            row = np.searchsorted(offsets, at, side="right") - 1
            for side, nearest, step in ((0, at - 1, -1), (1, at + n, 1)):
                around = np.zeros(len(at), np.uint64)
                for i in range(AROUND):
                    place = nearest + step * i
                    inside = (place >= offsets[row]) & (place < offsets[row + 1])
                    around = mix(around + np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0)) + np.uint64(1))
                order = np.lexsort((around, slot))
                names, around = slot[order], around[order]
                fresh = np.concatenate([[True], (names[1:] != names[:-1]) | (around[1:] != around[:-1])])
                grams = sent.value[names[fresh]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(np.full(len(grams), side, np.int32)), pa.array(around[fresh].view(np.int64))],
                    ["gram", "side", "around"],
                )

    found = lists.select("h").mapInArrow(contexts, "gram bigint, side int, around bigint")
    counts = [F.count_if(F.col("side") == side) for side in (0, 1)]
    return found.distinct().groupBy("gram").agg(F.least(*counts).alias("contexts"))


def _passages(docs: DataFrame, grams: np.ndarray, reach: np.ndarray, n: int) -> DataFrame:
    """(doc_id, start_word, words, grams): stretches around hits of the sorted ``grams``, with the gram's ``reach`` in words to
    either side where the text has them. Stretches that overlap are joined; joined ones longer than three times their largest
    reach come in tiles that overlap by that reach. ``grams`` are the distinct seeds in a tile."""
    sent = docs.sparkSession.sparkContext.broadcast((grams, reach))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, far = sent.value
        for batch in slices(batches, 1):
            _, offsets, at, slot = _hits(batch.column(1), known, n)
            if not len(at):
                continue
            row = np.searchsorted(offsets, at, side="right") - 1
            low, high = np.maximum(at - far[slot], offsets[row]), np.minimum(at + n + far[slot], offsets[row + 1])
            order = np.argsort(low, kind="stable")
            low, top = low[order], np.maximum.accumulate(high[order])
            new = np.flatnonzero(np.concatenate([[True], low[1:] >= top[:-1]]))
            begin, end = low[new], top[np.concatenate([new[1:], [len(low)]]) - 1]
            widest = np.maximum(np.maximum.reduceat(far[slot][order], new), n)
            tiles = np.maximum(-(-(end - begin - widest) // (2 * widest)), 1)
            group = np.repeat(np.arange(len(begin)), tiles)
            number = np.arange(len(group)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            first = begin[group] + 2 * widest[group] * number
            last = np.minimum(first + 3 * widest[group], end[group])
            a, b = np.searchsorted(at, first), np.searchsorted(at, last - n, side="right")
            used = a < b
            first, last, a, b = first[used], last[used], a[used], b[used]
            seeds = [np.unique(slot[i:j]) for i, j in zip(a, b, strict=True)]
            size = last - first
            ends = np.cumsum(size)
            texts = batch.column(2)
            places = np.arange(size.sum()) + np.repeat(first - (ends - size), size) + np.asarray(texts.offsets)[0]
            of = np.searchsorted(offsets, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of)),
                    pa.array(first - offsets[of], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), texts.values.take(pa.array(places))),
                    pa.array([known[x].view(np.int64) for x in seeds], pa.list_(pa.int64())),
                ],
                ["doc_id", "start_word", "words", "grams"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    split = docs.where("text IS NOT NULL").select("doc_id", let(normal_words(F.col("text")), lambda w: F.struct(hashes(w).alias("h"), w.alias("w"))).alias("x"))
    return split.select("doc_id", "x.h", "x.w").mapInArrow(
        cut_out, f"doc_id {kind}, start_word bigint, words array<string>, grams array<bigint>"
    )


def local_alignments(passages: list[list[str]], items: list[list[str]]) -> list[tuple[int, int, int]]:
    """(score, start, end) of the best local alignment of each passage with its item, in passage words.

    All pairs advance through their items together, one word at a time; the gap along the passage is a running maximum.
    Where several ends score alike the first is taken.
    """
    ends = _sweep(passages, items)
    turned = _sweep([p[:e][::-1] for p, (_, e) in zip(passages, ends, strict=True)], [i[::-1] for i in items])
    return [(s, e - back, e) for (s, e), (_, back) in zip(ends, turned, strict=True)]


def _sweep(passages: list[list[str]], items: list[list[str]]) -> list[tuple[int, int]]:
    count, wide, tall = len(passages), max(map(len, passages), default=0), max(map(len, items), default=0)
    if not (count and wide and tall):
        return [(0, 0)] * count
    p, q = np.full((count, wide), -1), np.full((count, tall), -2)
    for k, (a, b) in enumerate(zip(passages, items, strict=True)):
        ids = {w: i for i, w in enumerate(dict.fromkeys(b))}
        p[k, : len(a)] = [ids.get(w, -1) for w in a]
        q[k, : len(b)] = [ids[w] for w in b]
    ramp = np.arange(1, wide + 1) * -GAP
    above = np.zeros((count, wide + 1), np.int64)
    best, end = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i in range(tall):
        step = np.where(p == q[:, i : i + 1], MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        row[q[:, i] == -2] = 0  # past the item's end
        at = row.argmax(1)
        top = row[np.arange(count), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
        above = np.concatenate([np.zeros((count, 1), np.int64), row], axis=1)
    return [(int(s), int(e)) for s, e in zip(best, end, strict=True)]


def _align(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Adds score, begin, end; pairs of like size are aligned together, about ``SWEEP_WORDS`` words at a time.

    An alignment matches no more item words than those that stand anywhere in the passage; a pair whose score stays below
    ``threshold`` even if all of them match has score 0.
    """
    for batch in batches:
        common = [sum(map(set(w).__contains__, i)) for w, i in zip(batch["words"], batch["item"], strict=True)]
        open_ = np.flatnonzero(np.array(common) / batch["item_words"].to_numpy() >= threshold)
        size = np.array([max(len(batch["words"].iat[i]), len(batch["item"].iat[i])) for i in open_], np.int64)
        order = open_[np.argsort(size, kind="stable")]
        size = np.sort(size)
        out = [(0, 0, 0)] * len(batch)
        k = 0
        while k < len(order):
            wide = np.arange(1, min(256, len(order) - k) + 1) * size[k : k + 256]  # words of the first 1, 2, ... when padded alike
            part = order[k : k + max(int(np.searchsorted(wide, SWEEP_WORDS, side="right")), 1)]
            k += len(part)
            done = local_alignments([list(batch["words"].iat[i]) for i in part], [list(batch["item"].iat[i]) for i in part])
            for i, d in zip(part, done, strict=True):
                out[i] = d
        yield batch[["text_id", "text_id2", "item_id", "item_words"]].assign(
            score=[s for s, _, _ in out], begin=[b for _, b, _ in out], end=[e for _, _, e in out]
        )


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5, min_words: int = 8
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document with each item it contains.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. The score is the alignment's
    share of a full match of the item; rows below ``threshold``, or with alignments of fewer than ``min_words`` passage words
    (or the item's length, if less), are left out. A copy that keeps a seed of an item, that is n words in a row that are
    no everyday phrase, is always aligned with it, and its score is that of the best alignment anywhere around it. Items of fewer than ``n`` words are not searched for. Words count from 0 in the text's runs
    of letters and digits. Null or empty texts on either side give no rows; repeated rows are one; empty tables
    give an empty result.
    """
    items = cut(
        benchmark.where("text IS NOT NULL").select("item_id", normal_words(F.col("text")).alias("item")).where(F.size("item") >= n)
        .withColumn("item_words", F.size("item")).distinct()
    )
    blocks = -(-(items.agg(F.sum("item_words")).first()[0] or 0) // BLOCK_WORDS)
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _contained(docs, part, n, threshold, min_words)
        out = found if out is None else out.unionByName(found)
    kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    empty = f"doc_id {kind[0]}, item_id {kind[1]}, score double, start_word bigint, end_word bigint"
    return docs.sparkSession.createDataFrame([], empty) if out is None else out


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, size, gram) with the hashes that _passages computes and the item's number of words."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat, offsets = flat_lists(batch.column(1))
            at, got = _grams_of(flat, offsets, n)
            row = np.searchsorted(offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.diff(offsets)[row]), pa.array(got.view(np.int64))], ["item_id", "size", "gram"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", hashes(F.col("item")).alias("h")).mapInArrow(expand, f"item_id {kind}, size bigint, gram bigint")


def rare_seeds(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(item_id, gram, size): the n-grams of each item that are no everyday phrases, counted in ``docs`` and all items."""
    grams = cut(_item_grams(items, n))
    known = np.sort(np.asarray(grams.select("gram").distinct().toArrow().column("gram"), np.int64).view(np.uint64))  # at most a block
    lists = docs.where("text IS NOT NULL").select(hashes(normal_words(F.col("text"))).alias("h"))
    counts = _context_counts(lists.unionByName(items.select(hashes(F.col("item")).alias("h"))), known, n)
    usual = F.median("contexts").over(Window.partitionBy("item_id"))  # an item is bounded by the block
    return grams.join(counts, "gram").withColumn("usual", usual).where(F.col("contexts") <= EVERYDAY * F.col("usual")).select(
        "item_id", "gram", "size").distinct()


def _candidates(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The passages around seeds, and pairs (text_id, text_id2, item_id) of different passages and items that share a seed.

    An alignment that reaches the threshold covers at most (3 - 2 * threshold) times the item's words: each mismatch or gap
    costs half of what a match gives. That is the reach of a seed, so all such alignments lie inside one tile.
    """
    seeds = cut(rare_seeds(docs, items, n))
    sent = seeds.groupBy("gram").agg(F.max("size").alias("size")).toArrow()  # at most a block
    names = np.asarray(sent.column("gram"), np.int64).view(np.uint64)
    order = np.argsort(names)
    reach = np.ceil(np.asarray(sent.column("size"), np.int64)[order] * (3 - 2 * threshold)).astype(np.int64)
    passages = cut(
        _passages(docs, names[order], reach, n).withColumns(
            {"text_id": F.xxhash64("words"), "text_id2": F.xxhash64(F.lit("second"), "words")}
        )
    )
    # Equal passages of many documents are one row before n-grams are exploded.
    texts = cut(passages.groupBy("text_id", "text_id2").agg(F.first("grams").alias("grams")))
    exploded = texts.select("text_id", "text_id2", F.explode("grams").alias("gram"))
    return passages, exploded.join(seeds.select("item_id", "gram").distinct(), "gram").select("text_id", "text_id2", "item_id").distinct()


def _contained(docs: DataFrame, items: DataFrame, n: int, threshold: float, min_words: int) -> DataFrame:
    passages, pairs = _candidates(docs, items, n, threshold)
    words = passages.groupBy("text_id", "text_id2").agg(F.first("words").alias("words"))
    kind = items.schema["item_id"].dataType.simpleString()
    scored = (
        pairs.join(words, ["text_id", "text_id2"])
        .join(items, "item_id")
        .select("text_id", "text_id2", "item_id", "item_words", "words", "item")
        .mapInPandas(partial(_align, threshold=threshold), f"text_id bigint, text_id2 bigint, item_id {kind}, item_words int, score bigint, begin bigint, end bigint")
        .withColumn("score", F.col("score") / (MATCH * F.col("item_words")))
        .where((F.col("score") >= threshold) & (F.col("end") - F.col("begin") >= F.least(F.lit(min_words), "item_words")))
    )
    place = F.struct((F.col("start_word") + F.col("begin")).alias("s"), (F.col("start_word") + F.col("end")).alias("e"))
    return (
        passages.select("doc_id", "start_word", "text_id", "text_id2")
        .join(scored, ["text_id", "text_id2"])
        .groupBy("doc_id", "item_id")
        .agg(F.max("score").alias("score"), F.min_by(place, F.struct(-F.col("score"), place)).alias("p"))
        .select("doc_id", "item_id", "score", F.col("p.s").alias("start_word"), F.col("p.e").alias("end_word"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
