"""N-gram Jaccard join (operator 10): token-combination prefixes, exact verification, connected components.

Tokens are hashed word shingles, ordered by document frequency class and then by hash. Let a set of n tokens need at least
a common ones with any partner. The first common token of a pair stands among the first n - a + 1 tokens of both.

* If that token is rare, it is an index entry of both sets: rare tokens of the prefix are indexed one by one. Tokens of one
  document only are rarest of all and need no entry, which leaves most texts without any.
* If it is frequent, both sets have frequent tokens in their prefixes. Such sets extend the prefix to all their tokens, deal
  them into G hash classes and index the combination of the tokens of each class. Linked sets differ in at most e tokens, which
  spoil at most e classes, so with more than e classes in use one combination is common. G is e + 1 and a few to spare, so a
  combination has about six tokens (at a similarity of 0.85) however large the set is. Sets of one size level and the next meet
  under the larger level's G; sets that fill too few classes index their frequent prefix tokens one by one as well.

Copies are one set. Candidates of one entry are verified only while they lie in different components: a large group of near
copies is joined through a few representatives, never pair by pair, and what remains apart is verified in full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, components, flat_lists, gram_hashes, hashes, mix, slices, table, words
from tidemark.session import cut, cut_by

TOKEN_BITS = 48
#: Frequency classes (floor of log2) are kept for this many hash slots, one byte each: 32 MB for any input. A slot has the
#: class of its most frequent token; the order stays the same for all documents however full the slots are.
SLOT_BITS = 25
#: Tokens of at least 2 ** this documents count as frequent.
FREQUENT_CLASS = 6
#: Tokens that a task counts at once, and words from which it makes sets at once: bounds of its memory.
FLUSH = 1_000_000
PIECE = 1 << 18
#: Rounds of representatives go on while one in so many of their verifications is a link.
WORTH = 20
#: Bits of a set's marks, by which most candidates that do not link are told without their tokens.
MARKS = 1024


def token_sets(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) sorted, distinct: the n-word shingles of every row; a shorter row is one token, an empty row none."""
    length = np.diff(offsets)
    grams = gram_hashes(flat, n)
    end = np.repeat(offsets[1:], length)
    at = np.flatnonzero(np.arange(len(grams)) + n <= end[: len(grams)])
    row = np.repeat(np.arange(len(length)), length)[at]
    token = grams[at]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        whole = np.array([_sequence_hash(flat[offsets[r] : offsets[r + 1]]) for r in short], np.uint64)
        row, token = np.concatenate([row, short]), np.concatenate([token, whole])
    key = np.unique((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (token >> np.uint64(64 - TOKEN_BITS)))
    return (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)


def _sequence_hash(word_hashes: np.ndarray) -> np.uint64:
    out = np.full(1, len(word_hashes), np.uint64)
    for h in word_hashes.view(np.uint64):
        out = mix(out + h)
    return out[0]


def frequency_classes(hashed: DataFrame, n: int) -> np.ndarray:
    """floor(log2(document frequency)) per hash slot, over all documents.

    Tasks count their own tokens first and send them as packed 32-bit values per hash range (four bytes a token instead of a
    row); a range is then merged in one task. Ranges multiply with the shuffle partitions, so their size stays bounded.
    """
    spark = hashed.sparkSession
    bits = min(max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))), SLOT_BITS)
    low = TOKEN_BITS - bits - 32

    def packed(token: np.ndarray) -> pa.RecordBatch:
        value, count = np.unique(token >> np.uint64(low), return_counts=True)
        cuts = np.searchsorted(value >> np.uint64(32), np.arange((1 << bits) + 1))
        value = value.astype(np.uint32)
        rows = []
        for r in np.flatnonzero(np.diff(cuts)):
            v, c = value[cuts[r] : cuts[r + 1]], count[cuts[r] : cuts[r + 1]]
            once = c == 1
            rows.append((int(r), v[once].tobytes(), v[~once].tobytes(), c[~once].astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "once", "more", "counts"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 0, PIECE):
            token = token_sets(*flat_lists(batch.column(0)), n)[1]
            held.append(token)
            size += len(token)
            if size >= FLUSH:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def merge(rows: pa.Table) -> pa.Table:
        once, more, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32) for c in ("once", "more", "counts"))
        value = np.concatenate([once, more])
        order = np.argsort(value, kind="stable")
        value, weight = value[order], np.concatenate([np.ones(len(once)), counts])[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        total = np.log2(np.add.reduceat(weight, first)).astype(np.uint8)
        slot = value[first] >> np.uint32(32 - (SLOT_BITS - bits)) if bits < SLOT_BITS else np.zeros(len(first), np.uint32)
        lead = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        out = np.zeros(1 << (SLOT_BITS - bits), np.uint8)
        out[slot[lead]] = np.maximum.reduceat(total, lead)
        return pa.table({"part": rows.column("part").slice(0, 1), "classes": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    got = (
        hashed.select("h").mapInArrow(count, "part int, once binary, more binary, counts binary")
        .groupBy("part").applyInArrow(merge, "part int, classes binary").toArrow()
    )
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    wide = 1 << (SLOT_BITS - bits)
    for part, packed_classes in zip(got.column("part").to_pylist(), got.column("classes"), strict=True):
        out[part * wide : (part + 1) * wide] = np.frombuffer(zlib.decompress(packed_classes.as_py()), np.uint8)
    return out


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, n: int) -> int:
        """Least number of common tokens of a set of n with any partner."""
        return -(-self.num * n // self.den)

    def level(self, n: int) -> int:
        """Partners' levels differ by one at most: a level ends where the size has grown by the largest ratio of partners."""
        level, size = 0, 1
        while size < n:
            size = max(size * self.den // self.num, size + 1)
            level += 1
        return level

    def classes(self, level: int) -> tuple[int, int]:
        """(G, e) of a level: hash classes, and the most tokens in which linked sets of up to the level's size differ."""
        size = 1
        for _ in range(level):
            size = max(size * self.den // self.num, size + 1)
        errors = (self.den - self.num) * 2 * size // (self.den + self.num)
        return errors + 1 + errors // 20 + 2, errors


def signatures(token: np.ndarray, cls: np.ndarray, t: Threshold, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(singles, combinations) of one set whose tokens are in global order."""
    prefix = slice(0, len(token) - t.needed(len(token)) + 1)
    head, kind = token[prefix], cls[prefix]
    singles = head[(kind > 0) & (kind < FREQUENT_CLASS)]
    often = head[kind >= FREQUENT_CLASS]
    made = [np.empty(0, np.uint64)]
    for lev in (level, level + 1) if len(often) else ():
        salt = np.uint64((lev * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        count, errors = t.classes(lev)
        scrambled = mix(token + salt)
        part = scrambled % np.uint64(count)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0]))
        content = np.add.reduceat(mix(scrambled)[order], first)
        made.append(mix(content + part[order][first] + salt))
        if len(first) <= errors:
            made.append(mix(often + ~salt))
    return singles, np.unique(np.concatenate(made))


def _pack(token: np.ndarray) -> bytes:
    """Six bytes a token."""
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), np.uint8)], axis=1).reshape(-1).view("<u8")


def _marks(token: np.ndarray) -> np.ndarray:
    """``MARKS`` bits, each the parity of the tokens hashed to it. Sets whose marks differ in d bits differ in at least d tokens, and sets
    that differ in few tokens beside ``MARKS`` differ in nearly as many bits, however large they are."""
    at = (mix(token + np.uint64(5)) % np.uint64(MARKS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=MARKS) & 1).astype(np.uint8)).view(np.int64)


def set_records(hashed: DataFrame, sent: Broadcast, n: int, t: Threshold) -> DataFrame:
    """(doc_id, n_shingles, shared, sa, sb, tokens, marks, sigs) per row; ``shared`` counts the tokens that another document may hold,
    (sa, sb) is a 128-bit hash of the set; tokens, marks and sigs are null for sets without index entries. ``sent``: the frequency classes."""
    levels: dict[int, int] = {}

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot = sent.value
        for batch in slices(batches, 1, PIECE):
            rows = batch.num_rows
            row, token = token_sets(*flat_lists(batch.column(1)), n)
            size = np.bincount(row, minlength=rows)
            ends = np.concatenate([[0], np.cumsum(size)])
            sa, sb = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            some = np.flatnonzero(size)
            if len(some):
                sa[some] = np.add.reduceat(mix(token + np.uint64(1)), ends[some])
                sb[some] = np.add.reduceat(mix(mix(token) + np.uint64(77)), ends[some])
            cls = by_slot[token >> np.uint64(TOKEN_BITS - SLOT_BITS)]
            alone = np.bincount(row, cls == 0, minlength=rows)
            tokens: list[bytes | None] = [None] * rows
            marks: list[np.ndarray | None] = [None] * rows
            sigs: list[np.ndarray | None] = [None] * rows
            for r in some:
                m = int(size[r])
                if alone[r] >= m - t.needed(m) + 1:
                    continue  # only tokens of this document in the prefix
                own, c = token[ends[r] : ends[r + 1]], cls[ends[r] : ends[r + 1]]
                order = np.argsort(c, kind="stable")
                level = levels.setdefault(m, t.level(m))
                singles, combined = signatures(own[order], c[order], t, level)
                if len(singles) or len(combined):
                    tokens[r], sigs[r] = _pack(own), np.concatenate([singles, combined]).view(np.int64)
                    marks[r] = _marks(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(size.astype(np.int64) - alone.astype(np.int64)), pa.array(sa.view(np.int64)), pa.array(sb.view(np.int64)), pa.array(tokens, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "shared", "sa", "sb", "tokens", "marks", "sigs"],
            )

    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.select("doc_id", "h").mapInArrow(
        record, f"doc_id {kind}, n_shingles bigint, shared bigint, sa bigint, sb bigint, tokens binary, marks array<bigint>, sigs array<bigint>"
    )


def _near(t: Threshold) -> str:
    """Whether sets of n and m tokens with marks k and l may link."""
    differ = " + ".join(f"bit_count(k[{i}] ^ l[{i}])" for i in range(MARKS // 64))
    return f"{t.den + t.num} * (n + m - ({differ})) >= {2 * t.num} * (n + m)"


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Those rows of (a, b) whose sets reach the threshold. Marks are compared first; tokens move only for pairs that pass. ``sets`` are
    dealt by rep and stay where they are: what they send on are the sets that are asked for, once each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(t.den * both >= t.num * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs with these columns of both sets."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        held = sets.select("rep", *columns).join(asked, "rep")
        left, right = (held.select(F.col("rep").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)) for end in "ab")
        return pairs.join(left, "a").join(right, "b")

    kind = sets.schema["rep"].dataType.simpleString()
    marked = both(pairs, "n_shingles", "marks").select("a", "b", *(F.col(c).alias(x) for c, x in (("n_shingles_a", "n"), ("n_shingles_b", "m"), ("marks_a", "k"), ("marks_b", "l"))))
    near = cut(marked.where(_near(t)).select("a", "b").distinct())
    return cut(both(near, "tokens").select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, f"a {kind}, b {kind}"))


def _links(sets: DataFrame, t: Threshold) -> DataFrame:
    """Verified links (a, b) that connect everything that all links connect.

    Rounds: of every entry the component with most members stands still; each set outside it meets a member of it and one of the
    others, drawn anew each round but alike in all entries, so the copies of a text meet the same few. In the first round it is the
    one with the fewest tokens of its own: the text that the near copies stem from, or the nearest to it. A set is verified with two others a
    round at most, and only while it lies apart: rounds get smaller as groups grow together. They end when nothing lies apart or
    a round links fewer than one of ``WORTH`` it verified; what is still apart is then verified pair by pair.
    """
    kind = sets.schema["rep"].dataType.simpleString()
    # Sizes allow a link, and so do the tokens that are not the documents' own: the union is at least n + m less those.
    fits = F.expr(f"{t.den} * least(n, m) >= {t.num} * greatest(n, m) AND {t.den + t.num} * least(s, z) >= {t.num} * (n + m)")
    index = cut_by(
        sets.select("rep", F.col("n_shingles").alias("n"), F.col("shared").alias("s"), F.explode("sigs").alias("sig"), F.col("rep").alias("comp"), F.lit(0).alias("round")), "sig"
    )
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = sets.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    while True:
        # Dealt by entry once: the groupings and joins by entry below all read this one exchange (their filters on nulls would make
        # it several), and send nothing on themselves.
        index = index.where("rep IS NOT NULL AND sig IS NOT NULL AND comp IS NOT NULL").repartition(parts, "sig")
        # The round's number is a column, so every round runs the same compiled plans.
        drawn = F.struct(F.when(F.col("round") == 0, F.col("n") - F.col("s")).otherwise(0), F.xxhash64("round", "rep"))
        per = index.groupBy("sig", "comp").agg(
            F.count(F.lit(1)).alias("c"), F.min_by(F.struct("rep", "n", "s", "comp"), drawn).alias("one"), F.min(drawn).alias("draw")
        )
        chosen = per.groupBy("sig").agg(
            F.max_by("one", F.struct("c", F.negative("comp"))).alias("top"), F.count(F.lit(1)).alias("comps")
        ).where("comps > 1").select("sig", "top")
        aside = per.join(chosen, "sig").where(F.col("comp") != F.col("top.comp"))
        second = aside.groupBy("sig").agg(F.min_by("one", "draw").alias("next"))
        index = cut(index.join(chosen.join(second, "sig"), "sig"))
        apart = index.where(F.col("comp") != F.col("top.comp"))
        if apart.isEmpty():
            return links
        others = apart.select(
            "rep", "n", "s", "comp", "round", F.explode(F.array("top", "next")).alias("o")
        ).where(F.col("o.comp") != F.col("comp")).select("rep", "n", "s", "round", F.col("o.rep").alias("other"), F.col("o.n").alias("m"), F.col("o.s").alias("z")).where(fits)
        drawn = F.xxhash64("round", "other")
        own = F.when(F.col("round") == 0, F.col("m") - F.col("z")).otherwise(0)
        pairs = cut(
            others.groupBy("rep").agg(F.min_by("other", F.struct(own, drawn)).alias("x"), F.max_by("other", drawn).alias("y"))
            .select("rep", F.explode(F.array_distinct(F.array("x", "y"))).alias("other"))
            .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        )
        found = _verified(pairs, sets, t)
        met, linked = pairs.count(), found.count()
        links = links.unionByName(found)
        if linked:
            # A component takes the least name among itself and those it is linked with. Members of one that moves on keep the name they
            # share, and meet again next round: names never join what is not linked.
            label = index.select("rep", "comp").distinct()
            joined = found.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
            moved = joined.groupBy(F.col("e.x").alias("comp")).agg(F.least("comp", F.min("e.y")).alias("now"))
            index = index.join(moved, "comp", "left").withColumn("comp", F.coalesce("now", "comp"))
        index = index.select("rep", "n", "s", "sig", "comp", (F.col("round") + 1).alias("round"))
        if linked * WORTH <= met:
            break
    # What still lies apart: every pair of an entry from two components, the largest component's own members excepted, whose marks allow it.
    index = cut(index).where("rep IS NOT NULL AND sig IS NOT NULL").repartition(parts, "sig")
    largest = index.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1").drop("comps")
    marked = cut(index.join(largest, "sig").join(sets.select("rep", "marks"), "rep"))
    small = marked.where("comp <> top").select("sig", "rep", "n", "s", F.col("comp").alias("own"), F.col("marks").alias("k"))
    others = marked.select("sig", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("s").alias("z"), "comp", F.col("marks").alias("l"))
    pairs = cut(
        small.join(others, "sig").where((F.col("own") != F.col("comp")) & fits & F.expr(_near(t)))
        .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    )
    return cut(links.unionByName(_verified(pairs, sets, t)))


def similar_components(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when the Jaccard similarity of their sets of distinct n-word shingles (whitespace words, A-Z lower-cased)
    is at least ``similarity``; component_id is the smallest doc_id that links reach. A text of fewer than n words is one
    shingle; null, empty or blank texts have none and link with nothing. Rows that repeat a doc_id are one document with several texts.
    Rows with a null doc_id take no part and get a null component. An empty table gives an empty result.
    """
    t = Threshold(*similarity)
    hashed = docs.select("doc_id", hashes(words(ascii_lower(F.col("text")))).alias("h"))
    sent = docs.sparkSession.sparkContext.broadcast(frequency_classes(hashed, n))  # not kept on the driver beside
    records = cut(set_records(hashed, sent, n, t))
    sent.destroy()  # nothing reads it any more
    known = records.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(known.groupBy("sa", "sb").agg(F.min("doc_id").alias("rep")))
    members = cut(known.select("doc_id", "sa", "sb").join(classes, ["sa", "sb"]).select("doc_id", "sa", "sb", "rep"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = cut_by(
        known.where("sigs IS NOT NULL").select("doc_id", "n_shingles", "shared", "sa", "sb", "tokens", "marks", "sigs").repartition(parts, "doc_id")
        .join(classes.withColumnRenamed("rep", "doc_id").repartition(parts, "doc_id"), ["doc_id", "sa", "sb"])
        .dropDuplicates(["doc_id", "sa", "sb"])
        .select(F.col("doc_id").alias("rep"), "n_shingles", "shared", "tokens", "marks", "sigs"),
        "rep",
    )
    several = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same_id = members.join(several.select("doc_id", "low"), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    parts = components(_links(sets, t).unionByName(same_id)).withColumnRenamed("node", "rep")
    named = members.join(parts, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    return records.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), 4, (85, 100))


#: The same by brute force: all shingles of all texts joined with themselves.
ORACLE = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM split),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""
