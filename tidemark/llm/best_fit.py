"""Best-fit packing (operator 13): Martello-Toth dominance reduction, then best fit of what remains.

Packing depends on the lengths alone, and a length is at most the capacity, so the instance is a histogram of at most
``capacity`` numbers for any data. The driver reduces that histogram: a small set of lengths that provably dominates
every other set around its longest member is fixed, as often as the histogram allows at once, and taken out; best fit in
descending order packs the remainder. The result is a list of intervals per length (which ranks of a length
go to which sequences and offsets), counted in tens of thousands at most, against which tasks look up their rows' ranks.
Ranks come from a range sort on (length, doc_id, piece) with an identity of each row as the last key, so neither a hot length nor
a hot id meets in one task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table
from tidemark.operators.rowindex import with_row_index
from tidemark.session import cut

CAPACITY = 2048
END = 0  # the id behind every document
#: Words, and pieces of words, whose ids a task remembers; others are encoded whenever they occur.
REMEMBERED = 1 << 19
#: A character that is one token by itself, put between words that are encoded together.
MARK = "\x01"
JOINED = 256
#: The rules of the vocabulary that ``_Encoder`` follows itself for words of these letters. They are lower-cased
#: letter by letter and no composition changes them.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\na-z\u00df-\u00f6\u00f8-\u017f0-9]+")


class Placement(NamedTuple):
    """Ranks from ``first`` on of a length: each sequence from ``sequence`` on takes ``each`` of them, the first at ``offset``."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


class Plan(NamedTuple):
    placements: list[Placement]  # in order of length and first
    sequences: int
    fixed: int  # sequences that the reduction made


def _sums_of_several(lengths: list[int], most: int) -> int:
    """Bit s is set where two or more of ``lengths``, each as often as wanted, add up to s; sums up to ``most``."""
    mask = (1 << (most + 1)) - 1
    single = 0
    for n in lengths:
        single |= 1 << n
    reach = 1  # sums of any number
    for n in lengths:
        step = n
        while step <= most:
            reach |= (reach << step) & mask
            step *= 2
    several = 0
    for n in lengths:
        several |= (reach & ~1) << n
    return several & mask


class _Histogram:
    """Rows per length, with the answers that the reduction asks for."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)
        self.several: int | None = None

    def take(self, length: int, rows: int) -> None:
        self.counts[length] -= rows
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)
            self.several = None  # fewer lengths have fewer sums

    def best(self, gap: int, without: tuple[int, ...] = ()) -> int:
        """Longest length of at most ``gap`` of which a row is left besides ``without``; 0 for none."""
        for n in reversed(self.lengths[: int(np.searchsorted(self.lengths, gap, side="right"))]):
            if self.counts[n] > without.count(n):
                return n
        return 0

    def longest_sum(self, gap: int, most: int) -> int:
        """Upper bound on the sums up to ``gap`` of two or more rows: lengths may repeat without end."""
        if self.several is None:
            self.several = _sums_of_several(self.lengths, most)
        return (self.several & ((1 << (gap + 1)) - 1)).bit_length() - 1


def dominating_set(left: _Histogram, longest: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths to put beside one row of ``longest`` so that some optimal packing has this sequence; None if unknown.

    * () if nothing fits beside it;
    * (a,) where a is the longest that fits and no two or more others that fit add up to more than a: whatever stands
      beside ``longest`` in a packing can change places with a;
    * (a, b) where b is the longest that fits beside both, no three fit, and of any two that fit the shorter is at most b, or both
      together are at most a: one changes places with a, the other with b.
    """
    gap = capacity - longest
    a = left.best(gap, (longest,))
    if a == 0:
        return ()
    if left.longest_sum(gap, capacity) <= a:
        return (a,)
    b = left.best(gap - a, (longest, a))
    if b == 0:
        return None
    shortest = [n for n in left.lengths[:3] for _ in range(min(left.counts[n], 3))][:3]
    if len(shortest) == 3 and sum(shortest) <= gap:
        return None
    for s in reversed(left.lengths[: int(np.searchsorted(left.lengths, gap // 2, side="right"))]):
        if s <= b:
            return a, b
        partner = left.best(gap - s, (longest, s))
        if partner >= s and partner + s > a:
            return None
    return a, b


def _bulk(left: _Histogram, members: list[int]) -> int:
    """How many copies of the set the histogram holds."""
    return min(left.counts[n] // members.count(n) for n in set(members))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for ``histogram`` (length -> rows, 1 <= length <= capacity).

    The reduction goes over the lengths from the longest down, again and again until it finds nothing. A set whose rows add up to
    the capacity, or beside whose longest member nothing else fits, stays dominating as rows go, so all its copies are fixed at
    once; this holds for every set, since removing rows only removes alternatives.
    """
    left = _Histogram(histogram)
    used = dict.fromkeys(histogram, 0)
    out: list[Placement] = []
    sequences = 0

    def place(length: int, first_sequence: int, rows: int, each: int, offset: int) -> None:
        if rows:
            out.append(Placement(length, used[length], first_sequence, each, offset))
            used[length] += rows

    changed = True
    while changed:
        changed = False
        for longest in sorted(left.counts, reverse=True):
            while left.counts.get(longest):
                beside = dominating_set(left, longest, capacity)
                if beside is None:
                    break
                members = [longest, *beside]
                copies = _bulk(left, members)
                offset = 0
                for n in sorted(set(members), reverse=True):
                    each = members.count(n)
                    place(n, sequences, copies * each, each, offset)
                    left.take(n, copies * each)
                    offset += n * each
                sequences += copies
                changed = True
    fixed = sequences

    # Best fit, longest first. ``open_`` has for each room left the runs (first sequence, number) of equal sequences.
    open_: dict[int, list[tuple[int, int]]] = {}
    for length in sorted(left.counts, reverse=True):
        rows = left.counts[length]
        while rows:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                room, first, many = capacity, sequences, -(-rows // (capacity // length))
                sequences += many
            else:
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // length
            full = min(rows // each, many)
            place(length, first, full * each, each, capacity - room)
            rows -= full * each
            if full:
                open_.setdefault(room - each * length, []).append((first, full))
            if full < many:
                part = min(rows, each)  # fewer than would fill one more sequence
                place(length, first + full, part, each, capacity - room)
                rows -= part
                if part:
                    open_.setdefault(room - part * length, []).append((first + full, 1))
                if many - full - (part > 0):
                    open_.setdefault(room, []).append((first + full + (part > 0), many - full - (part > 0)))
    return Plan(sorted(out), sequences, fixed)


class _Encoder:
    """Ids of words. Words of the letters in ``_PLAIN`` are cut into the vocabulary's pieces, and each different piece is looked up in
    its merges once; all other words, and all words of a vocabulary with other rules, go through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stop = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.own = steps == STEPS and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex") == SPLIT
        # A byte is written as the letter of its code; those without a visible letter take the codes from 256 on.
        self.letters, beyond = {}, 256
        for byte in range(256):
            if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
                continue
            self.letters[byte] = chr(beyond)
            beyond += 1
        self._forget()

    def _forget(self) -> None:
        self.at = {"\n": 0}
        self.flat, self.sizes = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids one after the other, and how many each has."""
        own, rest = [], []
        for w in words:
            (own if self.own and _PLAIN.fullmatch(w) and "<|" not in w else rest).append(w)
        flat, sizes = self._by_pieces(own)
        rest, more, more_sizes = self._whole(rest)
        return own + rest, np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])

    def _by_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = _PIECES.findall("\n".join([*words, ""]).lower())  # a line end behind every word
        if len(self.at) > REMEMBERED:
            self._forget()
        fresh = list(set(pieces).difference(self.at))
        merged = self.tokenizer.model.tokenize
        ids, sizes = [], []
        for p in fresh:
            got = merged(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))
            sizes.append(len(got))
            ids += [t.id for t in got]
        self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
        self.flat = np.concatenate([self.flat, np.array(ids, "<u4")])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        long_ = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(long_)])
        firsts = np.cumsum(self.sizes) - self.sizes
        out = self.flat[np.arange(ends[-1]) + np.repeat(firsts[which] - ends[:-1], long_)]
        return out, np.diff(ends[np.flatnonzero(which == 0)], prepend=0)

    def _whole(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words are encoded ``JOINED`` at a time with a mark behind each, few of these texts at once, since the library's results
        are large; a word that holds the mark, or might hold a special token, stands alone."""
        plain = [w for w in words if MARK not in w and "<|" not in w]
        odd = [w for w in words if MARK in w or "<|" in w]
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for i in range(0, len(plain), JOINED):
            got = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*plain[i : i + JOINED], ""])], add_special_tokens=False)[0].ids
            got = np.array(got, "<u4")
            ends = np.flatnonzero(got == self.stop)
            ids.append(got[got != self.stop])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        for w in odd:
            ids.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4"))
            sizes.append(np.array([len(ids[-1])]))
        return plain + odd, np.concatenate(ids), np.concatenate(sizes)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs`` (doc_id, text; other columns are ignored).

    A document is the tokenizer's ids of its text, without special ones, then id 0. One of more than ``capacity`` ids is cut into pieces of
    that many, the last may be shorter. ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is the end id alone. White
    space separates tokens in this vocabulary, so a task encodes each distinct word once and looks the others up. Empty words between
    spaces have no ids.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        encoder = _Encoder(tokenizer_path)

        def split() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spaced = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
                yield pa.RecordBatch.from_arrays([batch.column(0), spaced], names=["doc_id", "words"])

        known: dict[str, int] = {}
        flat, sizes = np.empty(0, "<u4"), np.empty(0, np.int64)
        for batch in slices(split(), 1, 1 << 19):
            offsets = np.asarray(batch.column(1).offsets).astype(np.int64)
            inside = batch.column(1).values.slice(offsets[0], offsets[-1] - offsets[0])  # stays in Arrow: no Python object per word
            offsets = offsets - offsets[0]
            coded = inside.dictionary_encode() if len(inside) else None
            entries = coded.dictionary.to_pylist() if coded else []
            fresh, new_flat, new_sizes = encoder.encoded([w for w in entries if w not in known])
            here = dict(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            all_flat, all_sizes = np.concatenate([flat, new_flat]), np.concatenate([sizes, new_sizes])
            firsts = np.cumsum(all_sizes) - all_sizes
            where = np.fromiter((known[w] if w in known else here[w] for w in entries), np.int64, len(entries))
            at = where[np.asarray(coded.indices)] if coded else np.empty(0, np.int64)
            if len(known) < REMEMBERED:  # the words met first are the frequent ones
                room = REMEMBERED - len(known)
                known.update(zip(fresh[:room], range(len(known), len(known) + room), strict=False))
                sizes = all_sizes[: len(known)]
                flat = all_flat[: int(sizes.sum())]
            long_ = all_sizes[at]
            ends = np.concatenate([[0], np.cumsum(long_)])
            tokens = all_flat[np.arange(ends[-1]) + np.repeat(firsts[at] - ends[:-1], long_)]
            doc_ends = ends[offsets[1:]]
            everything = np.insert(tokens, doc_ends, END).astype("<u4")
            whole = np.diff(np.concatenate([[0], doc_ends])) + 1  # ids of each document, the end included
            begins = np.concatenate([[0], np.cumsum(whole)])[:-1]
            pieces = -(-whole // capacity)
            doc = np.repeat(np.arange(len(whole)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(whole[doc] - start, capacity)
            edges = (np.append((begins[doc] + start), len(everything)) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(everything.tobytes())]),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut_up, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary"
    )


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, any other columns) with sequence_id and offset.

    Sequences are numbered from 0 and hold their pieces without gaps from offset 0. Rows of equal length take their places by
    (doc_id, piece), nulls first; rows that repeat these are packed each for itself. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    known = cut(pieces.select("*", F.monotonically_increasing_id().alias("__row")))
    placed = with_row_index(known, ["length", "doc_id", "piece", "__row"], "__at").drop("__row")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    made = plan(counts, capacity)
    begin, rank = {}, 0
    for n in sorted(counts):
        begin[n] = rank
        rank += counts[n]
    # First row of each placement in the sorted order: placements of a length follow each other, and lengths ascend.
    table_ = np.array([(begin[p.length] + p.first, p.sequence, p.each, p.offset) for p in made.placements], np.int64).reshape(-1, 4)
    told = spark.sparkContext.broadcast(table_)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, sequence, each, offset = told.value.T
        for batch in batches:
            at = np.asarray(batch.column("__at")).astype(np.int64)
            length = np.asarray(batch.column("length")).astype(np.int64)
            k = np.searchsorted(firsts, at, side="right") - 1
            within = at - firsts[k]
            columns = [*batch.columns[:-1], pa.array(sequence[k] + within // each[k]), pa.array(offset[k] + within % each[k] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = placed.drop("__at").schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(seat, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``token_pieces`` of ``docs`` with their sequence and offset; ids included."""
    return best_fit(token_pieces(docs, tokenizer_path, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from ``packed_documents``: the ids of each sequence, ready to be written; at most ``capacity`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
