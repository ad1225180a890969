"""Conversation structure repair (operator 12): Wagner-Fischer alignment with the legal role strings.

The role initials of a legal conversation are (s?(ua)+)?, so its length determines it. Turns are aligned with the string of each
feasible length: a turn is kept, given another role or deleted, an empty turn is inserted. Lengths that share an end
share their table, filled from the end of the turns, so the cells of one row over all lengths are one vector. Cells off the diagonal by
more than the incumbent's cost allows are left out (Ukkonen); if the alignment found costs more than the band
covers, the band is widened to what that cost allows. All cheapest audits are then walked from the front at once, letter by
letter, keeping those with the least letter: what is left is the ASCII-least of the backtraced audits.

A conversation may be long, so its turns are first cut into pieces of at most ``PIECE`` and a piece is aligned for each state of the
grammar before and after it. Pieces end with the letter of a turn, hence no audit of a piece begins another one, and
cheapest least audits of pieces chain to the cheapest least audit of all. Pieces are spread over tasks by a range sort; the
last pass reads a conversation's turns in order, batch by batch, since its hash is one sequence. A task holds some numbers a
piece and the audit itself, never the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, crc32_sql, table
from tidemark.operators.rowindex import with_row_index
from tidemark.session import cut

PIECE = 256
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
FAR = 1 << 40
#: States of the grammar: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
S, U, A = 1, 2, 3  # classes of a role by its initial; 0 for any other
REMEMBERED = 1 << 16


class _Turns:
    """A piece: class of each turn, whether it must go, what keeping it adds. One character a turn, see ``symbol``."""

    def __init__(self, symbols: str):
        codes = [ord(c) - 64 for c in symbols]
        self.n = len(codes)
        self.kind = [c & 3 for c in codes]
        self.forced = [c >> 2 & 1 for c in codes]
        self.extra = [c >> 3 & 1 for c in codes]
        self.least = DELETE * sum(self.forced) + TRUNCATED * sum(self.extra)  # no alignment costs less
        self.free = [0] * (self.n + 1)  # turns from i on that may stay
        for i in range(self.n - 1, -1, -1):
            self.free[i] = self.free[i + 1] + 1 - self.forced[i]


def _tables(turns: _Turns, end: int, last: bool, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per turn i, the cost of aligning turns i.. with the last r letters of a string that ends with class ``end``.

    Column k of row i stands for r = free[i] - width + k. Second: the cost of the turn's own letter in that column (keep or
    new role; FAR where it must go). Insertions stand before a turn, or behind all of them where the piece is the last.
    """
    columns = np.arange(2 * width + 1)
    r = columns - width
    bottom = np.where(r == 0, 0, FAR) if not last else np.where(r >= 0, INSERT * r, FAR)
    rows, own = [bottom], []
    for i in range(turns.n - 1, -1, -1):
        r = turns.free[i] - width + columns
        below = rows[-1]
        if turns.forced[i]:
            best = below + DELETE
            own.append(np.full(len(columns), FAR))
        else:
            letter = np.where(r % 2 == 1, end, U + A - end)
            cost = np.where(letter == turns.kind[i], 0, REROLE) + turns.extra[i] * TRUNCATED
            own.append(np.where(r > 0, cost, FAR))
            best = np.minimum(below + own[-1], np.append(below[1:], FAR) + DELETE)
        best = np.where(r >= 0, best, FAR)
        # The cheapest number of insertions before turn i: a running minimum along r.
        best = np.minimum.accumulate(best - INSERT * columns) + INSERT * columns
        rows.append(np.where(r >= 0, np.minimum(best, FAR), FAR))
    return rows[::-1], own[::-1]


class _Aligner:
    """Tables of one piece for one last letter, and what can be read from them."""

    def __init__(self, turns: _Turns, end: int, last: bool):
        self.turns, self.end, self.last = turns, end, last
        self.width = 2
        self._fill()

    def _fill(self) -> None:
        t = self.turns
        self.rows, self.own = _tables(t, self.end, self.last, self.width)
        columns = np.arange(2 * self.width + 1)
        self.r = [t.free[i] - self.width + columns for i in range(t.n + 1)]
        #: Cheapest way from turn i on if the first turn that stays is one with s, followed by u.
        self.with_s = [FAR] * (t.n + 1)
        for i in range(t.n - 1, -1, -1):
            self.with_s[i] = self.with_s[i + 1] + DELETE
            if t.kind[i] == S and not t.forced[i]:
                stay = self._least(i + 1, self._starts(i + 1, U) & (self.r[i + 1] > 0))
                self.with_s[i] = min(self.with_s[i], stay + t.extra[i] * TRUNCATED)

    def _starts(self, i: int, first: int) -> np.ndarray:
        """Columns whose letters begin with class ``first`` (an even number of letters ends with the other class)."""
        return (self.r[i] >= 0) & (self.r[i] % 2 == (1 if first == self.end else 0))

    def _least(self, i: int, columns: np.ndarray) -> int:
        return int(self.rows[i][columns].min(initial=FAR))

    def best(self, first: int, empty: bool, s: bool) -> tuple[int, str]:
        """Cost and least audit over all feasible lengths of strings that begin with class ``first``; ``empty`` allows length 0, ``s`` a
        kept turn with s in front."""
        while True:
            asked = self._starts(0, first) & ((self.r[0] > 0) | empty)
            cost = self._least(0, asked)
            if s:
                cost = min(cost, self.with_s[0])
            needed = (cost - self.turns.least) // min(INSERT, DELETE - TRUNCATED)
            full = 2 * self.turns.n + 4
            if needed <= self.width or self.width >= full:
                break
            self.width = min(max(needed, 2 * self.width) if cost >= FAR else needed, full)
            self._fill()
        if cost >= FAR:
            return FAR, ""
        return cost, self._walk(asked & (self.rows[0] == cost), s and self.with_s[0] == cost)

    def _walk(self, alive: np.ndarray, before_s: bool) -> str:
        t, out, i = self.turns, [], 0
        while True:
            here = self.rows[i]
            if i < t.n:
                below = self.rows[i + 1]
                deleted = (below if t.forced[i] else np.append(below[1:], FAR)) + DELETE
                go = alive & (deleted == here)
                wait = before_s and self.with_s[i] == self.with_s[i + 1] + DELETE
                if go.any() or wait:
                    out.append("D")
                    alive = go if t.forced[i] else np.append(False, go[:-1])
                    before_s = wait
                    i += 1
                    continue
            if i < t.n or self.last:
                go = alive[1:] & (here[:-1] + INSERT == here[1:]) & (self.r[i][1:] > 0)
                if go.any():
                    out.append("I")
                    alive, before_s = np.append(go, False), False
                    continue
            if i == t.n:
                return "".join(out)
            stay = alive & (self.own[i] + below == here)
            kept = stay & (self.own[i] == t.extra[i] * TRUNCATED)
            begin = np.zeros(len(alive), bool)
            if before_s and t.kind[i] == S and not t.forced[i]:
                begin = self._starts(i + 1, U) & (self.r[i + 1] > 0) & (below + t.extra[i] * TRUNCATED == self.with_s[i])
            keep = kept.any() or begin.any()
            out.append("K" if keep else "R")
            alive = kept | begin if keep else stay
            before_s = False
            i += 1


def piece_options(symbols: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, least audit) of a piece; unreachable pairs are left out. The last piece ends legally."""
    turns = _Turns(symbols)
    gone = DELETE * turns.n, "D" * turns.n
    ends = {AFTER_A: _Aligner(turns, A, last)}
    if not last:
        ends[AFTER_U] = _Aligner(turns, U, last)
    out = [(START, START, *gone)]
    for after, aligner in ends.items():
        out.append((START, after, *aligner.best(U, False, True)))
        if not first:
            out.append((AFTER_S, after, *aligner.best(U, False, False)))
            out.append((AFTER_A, after, *aligner.best(U, after == AFTER_A, False)))
            out.append((AFTER_U, after, *aligner.best(A, after == AFTER_U, False)))
    if not last:
        if not first:
            out.append((AFTER_S, AFTER_S, *gone))
        stays = [(turns.extra[i], -i) for i in range(turns.n) if turns.kind[i] == S and not turns.forced[i]]
        if stays:  # one turn with s stays, the last of the cheapest (D comes before K)
            extra, i = min(stays)
            out.append((START, AFTER_S, gone[0] - DELETE + extra * TRUNCATED, "D" * -i + "K" + "D" * (turns.n + i - 1)))
    return [o for o in out if o[2] < FAR]


def chain(pieces: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[int]]:
    """Total cost and the option taken in each piece from (state before, state after, cost, place of its audit among the
    piece's audits in ASCII order)."""
    ahead = [[FAR] * 4 for _ in range(len(pieces) + 1)]
    ahead[-1] = [0, FAR, FAR, 0]
    for k in range(len(pieces) - 1, -1, -1):
        for before, after, cost, _ in pieces[k]:
            ahead[k][before] = min(ahead[k][before], cost + ahead[k + 1][after])
    taken, states = [], {START}
    # Different ways may share the audit of a piece and differ in the state behind it: all of them go on.
    paths: list[dict[int, tuple[int, int]]] = []
    for k, options in enumerate(pieces):
        fits = [(place, before, after, i) for i, (before, after, cost, place) in enumerate(options) if before in states and cost + ahead[k + 1][after] == ahead[k][before]]
        least = min(f[0] for f in fits)
        paths.append({after: (before, i) for place, before, after, i in fits if place == least})
        states = set(paths[-1])
    state = min(states) if states else START
    for step in reversed(paths):
        state, i = step[state]
        taken.append(i)
    return ahead[0][START], taken[::-1]


def _said(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with planted damage by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the
    turn, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it (``copy`` 1), 4 makes its role user. Nulls are read as one blank."""
    code = F.crc32(F.concat(_said(F.col("conv_id")), F.lit(":"), _said(F.col("turn")))) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(_said(F.col("text")), ".!?", "")).otherwise(_said(F.col("text")))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(_said(F.col("role"))).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def _pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, block, symbols, first, last, blank, duplicate, truncated) from turns with role, digest, is_blank, is_open."""
    order = ["conv_id", "turn", "role", "digest", "copy", "__row"]
    placed = with_row_index(cut(turns.withColumn("__row", F.monotonically_increasing_id())), order, "at")
    again = (
        placed.where("NOT is_blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("since"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    same = F.col("p.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("p.role") == F.col("g.role")) & (F.col("p.digest") == F.col("g.digest"))
    marked = placed.alias("p").join(again.alias("g"), same & ~F.col("p.is_blank"), "left").select(
        "p.conv_id", "at", "p.role", "is_blank",
        (~F.col("is_blank") & F.coalesce(F.col("at") > F.col("since"), F.lit(False))).alias("is_again"), "is_open",
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(0)
    is_cut = F.col("is_open") & ~F.col("is_blank") & ~F.col("is_again")
    symbol = F.char(F.lit(64) + kind + (F.col("is_blank") | F.col("is_again")).cast("int") * 4 + is_cut.cast("int") * 8)
    blocks = marked.groupBy("conv_id", F.floor(F.col("at") / PIECE).cast("bigint").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", symbol.alias("c")))), lambda x: x["c"]), "").alias("symbols"),
        F.sum(F.col("is_blank").cast("bigint")).alias("blank"),
        F.sum(F.col("is_again").cast("bigint")).alias("duplicate"),
        F.sum(is_cut.cast("bigint")).alias("truncated"),
    )
    along = Window.partitionBy("conv_id").orderBy("block")
    return blocks.select(
        "*", F.lag("block").over(along).isNull().alias("first"), F.lead("block").over(along).isNull().alias("last")
    ).repartition("conv_id", "block")


def _aligned(pieces: DataFrame) -> DataFrame:
    """Pieces with ``options`` (before, after, cost, place of the audit among the piece's in ASCII order) and their ``audits``."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[list, list]] = {}
        for batch in batches:
            options, audits = [], []
            for key in zip(*(batch.column(c).to_pylist() for c in ("symbols", "first", "last")), strict=True):
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known = {}
                    found = piece_options(*key)
                    places = {a: i for i, a in enumerate(sorted({o[3] for o in found}))}
                    known[key] = [x for o in found for x in (*o[:3], places[o[3]])], [o[3] for o in found]
                options.append(known[key][0])
                audits.append(known[key][1])
            kept = [batch.column(c) for c in ("conv_id", "block", "blank", "duplicate", "truncated")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(options, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                names=["conv_id", "block", "blank", "duplicate", "truncated", "options", "audits"],
            )

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(
        align, f"conv_id {kind}, block bigint, blank bigint, duplicate bigint, truncated bigint, options array<bigint>, audits array<string>"
    )


ROLE = {S: "system", U: "user", A: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}  # fixed values


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.faults = [0, 0, 0]
        self.pieces: list[list[tuple[int, int, int, int]]] = []
        self.taken: list[int] | None = None
        self.cost = self.illegal = self.turns = 0
        self.audit = bytearray()
        self.at = self.seen = 0  # next letter of the audit, pieces seen
        self.least = self.most = self.initial = None
        self.emitted = 0
        self.state = START
        self.sha = hashlib.sha256()

    def piece(self, faults: tuple[int, int, int], options: list[int]) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.pieces.append([tuple(options[i : i + 4]) for i in range(0, len(options), 4)])

    def letters(self, audits: list[str]) -> None:
        if self.taken is None:
            self.cost, self.taken = chain(self.pieces)
            self.pieces = []
        self.audit += audits[self.taken[self.seen]].encode()
        self.seen += 1

    def _say(self, role: str, text: str, kind: int) -> None:
        if self.emitted:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:".encode())
        self.sha.update(text.encode())
        self.emitted += 1
        self.state = kind

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == 73:  # I
            kind = A if self.state == AFTER_U else U
            self._say(ROLE[kind], "", kind)
            self.at += 1

    def turn(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL_PAIRS
        self.initial = role[:1]
        self._insertions()
        letter = chr(self.audit[self.at])
        self.at += 1
        if letter == "K":
            self._say(role, text, {"s": S, "u": U, "a": A}[role[:1]])
        elif letter == "R":
            kind = A if self.state == AFTER_U else U
            self._say(ROLE[kind], text, kind)

    def result(self) -> tuple:
        self._insertions()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, *self.faults, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_conversations(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults, cheapest cost and audit, and hash of the repair of ``turns``.

    ``turns``: conv_id, turn, role, text (neither role nor text null), copy. They are taken by turn, nulls first; turns of equal number by role,
    then text digest, so equal rows follow each other and all but the first are duplicates. Faults: ``blank``, ``duplicate`` (same role and text
    before it), ``truncated`` (last character that is not white is none of ``.!?``); the first that holds counts. ``illegal`` counts neighbours
    whose initials are none of su, ua, au; ``gaps`` the turn numbers missing between least and greatest. A role whose first letter is not s,
    u or a, also an empty one, cannot be kept. A null conv_id is a conversation. Without turns: zeros, an empty audit, the hash of nothing.
    """
    stripped = _stripped(F.col("text"))
    narrow = turns.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "copy", (stripped == "").alias("is_blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("is_open"),
    )
    aligned = cut(_aligned(_pieces(narrow)))
    nothing = {c: F.lit(None).cast(t) for c, t in (("block", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("options", "array<bigint>"), ("audits", "array<string>"), ("turn", turns.schema["turn"].dataType), ("role", "string"), ("digest", "string"), ("copy", "int"), ("text", "string"))}

    def shaped(df: DataFrame, stage: int) -> DataFrame:
        return df.select("conv_id", F.lit(stage).alias("stage"), *[F.col(c) if c in df.columns else v.alias(c) for c, v in nothing.items()])

    everything = (
        shaped(conversations.select("conv_id").distinct(), 0)
        .unionByName(shaped(aligned.drop("audits"), 1))
        .unionByName(shaped(aligned.select("conv_id", "block", "audits"), 2))
        .unionByName(shaped(turns.withColumn("digest", F.sha2("text", 256)), 3))
    )
    order = ["conv_id", "stage", "block", "turn", "role", "digest", "copy"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        fields = ("conv_id", "stage", "blank", "duplicate", "truncated", "options", "audits", "turn", "role", "text")
        for batch in batches:
            done = []
            for conv, stage, blank, duplicate, cut_, options, audits, turn, role, text in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if stage == 0:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                elif stage == 1:
                    now.piece((blank, duplicate, cut_), options)
                elif stage == 2:
                    now.letters(audits)
                else:
                    now.turn(turn, role, text)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([now.result()])

    kind = conversations.schema["conv_id"].dataType
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [arrow_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(COLUMNS))

    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COLUMNS[1:7]) + ", audit string, repaired_sha256 string"
    # One partition number a conversation, so that adaptive execution may not split it between tasks.
    return everything.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired_conversations(conversations, damaged(conversations))


def _fold_sql() -> str:
    """Forward costs and least audits per state as one sortable text (eight digits, then letters); two insertions in a row never pay."""

    def add(state: str, cost: str, letters: str) -> str:
        return f"lpad((substr({state}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || {letters}"

    out = []
    for after, kind, ways in (
        ("n", None, []), ("s", S, [("n", 0)]), ("u", U, [("n", 0), ("s", 0), ("a", 0), ("u", 1)]), ("a", A, [("u", 0), ("n", 1), ("s", 1), ("a", 1)]),
    ):
        tries = [add(f"f.{after}", str(DELETE), "'D'")]
        for before, inserted in ways:
            own = f"CASE WHEN r.kind = {kind} THEN 0 ELSE {REROLE if kind != S else 'NULL'} END + r.extra + {INSERT * inserted}"
            letter = f"'{'I' * inserted}' || CASE WHEN r.kind = {kind} THEN 'K' ELSE 'R' END"
            tries.append(f"CASE WHEN NOT r.forced THEN {add(f'f.{before}', own, letter)} END")
        out.append(f"least({', '.join(tries)}, NULL) AS {after}")
    return ",\n    ".join(out)


_WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE)
ORACLE = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code
  FROM conversations
), turns AS (
  SELECT conv_id, turn, copy, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, LATERAL (SELECT unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy) WHERE code <> 0
), names AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), ordered AS (
  SELECT conv, turn, role, text, rtrim(text, {_WHITE_SQL}) AS body,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos
  FROM turns t JOIN names n ON t.conv_id IS NOT DISTINCT FROM n.conv_id
), judged AS (
  SELECT *, body = '' AS is_blank, body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS is_again,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) || left(role, 1) AS pair
  FROM ordered
), kinds AS (
  SELECT *, is_blank OR is_again AS forced, CASE left(role, 1) WHEN 's' THEN {S} WHEN 'u' THEN {U} WHEN 'a' THEN {A} ELSE 0 END AS kind,
    CASE WHEN NOT is_blank AND NOT is_again AND right(body, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS extra
  FROM judged
), fold(conv, pos, n, s, u, a) AS (
  SELECT conv, 0::BIGINT, '00000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM names
  UNION ALL
  SELECT f.conv, r.pos,
    {_fold_sql()}
  FROM fold f JOIN kinds r ON r.conv = f.conv AND r.pos = f.pos + 1
), ends AS (
  SELECT conv, least(n, a, lpad((substr(u, 1, 8)::BIGINT + {INSERT})::VARCHAR, 8, '0') || substr(u, 9) || 'I') AS best
  FROM fold QUALIFY pos = max(pos) OVER (PARTITION BY conv)
), letters AS (
  SELECT conv, i, substr(best, i::BIGINT, 1) AS letter FROM (SELECT conv, best, unnest(range(9, length(best) + 1)) AS i FROM ends)
), marks AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w - 1 AS j,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv) % 2 AS odd
  FROM letters WINDOW w AS (PARTITION BY conv ORDER BY i)
), repaired AS (
  SELECT m.conv, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (j - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha
  FROM marks m LEFT JOIN kinds k ON k.conv = m.conv AND k.pos = m.pos AND m.letter <> 'I' WHERE letter <> 'D' GROUP BY m.conv
), faults AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_again) AS duplicate, sum(extra)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0) AS illegal, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM names JOIN ends USING (conv) LEFT JOIN faults USING (conv) LEFT JOIN repaired USING (conv)
"""
