"""Chat formatting (operator 9): minimum-cost repair of role sequences, then rendering.

The legal-turn automaton: an optional system turn, then user and assistant in turn, ended by the assistant. A turn can
be kept, merged into the turn before it, or relabelled, and empty turns can be inserted. The cheapest sequence of these
is a shortest path, found by dynamic programming over the automaton's four states.

Turns are range-partitioned by conversation and position, so a conversation of any size is spread over tasks. A piece
of a conversation in one task is summarised by the cost of going from each state to each state (a 4 x 4 matrix); the
at most two unfinished pieces of every task are chained on the driver, which fixes the states at the task borders, and
each task then repairs its own turns. The chain has two small rows per task, whatever the data size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.session import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_ROLE = ("", *ROLES)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST_MERGE, COST_RELABEL, COST_INSERT, COST_UNKNOWN = 2, 3, 4, 1
INFINITE = 1 << 50
#: Other names of the roles.
SYNONYMS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant"}


def role_state(role: str | None) -> int:
    """State of a role name, 0 for an unknown one."""
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return STATE_ROLE.index(name) if name in ROLES else 0


def _insertions() -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """(from, to) -> (cost, inserted states) of the cheapest insertion of up to two empty turns."""
    best: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {(s, s): (0, ()) for s in range(4)}
    for n in (1, 2):
        for s in range(4):
            for path in itertools.product(range(1, 4), repeat=n):
                legal = all(b in LEGAL[a] for a, b in zip((s, *path), path, strict=False))
                if legal and (s, path[-1]) not in best:
                    best[s, path[-1]] = (n * COST_INSERT, path)
    return best


INSERTIONS = _insertions()


def _moves(kind: int) -> dict[int, list[tuple[int, int, tuple[int, ...], str]]]:
    """For a turn of role state ``kind`` (0: unknown): state -> [(next state, cost, insertions before, action)], one per
    next state. Ties go to keeping, then merging, then relabelling, then fewer insertions."""
    out: dict[int, list[tuple[int, int, tuple[int, ...], str]]] = {}
    for s in range(4):
        options: dict[int, tuple[int, int, tuple[int, ...], str]] = {}
        for (a, mid), (cost, inserted) in INSERTIONS.items():
            if a != s:
                continue
            tries = [(t, COST_UNKNOWN if kind == 0 else (0 if t == kind else COST_RELABEL), "keep" if t == kind else "relabel") for t in LEGAL[mid]]
            if mid != START and not inserted and (kind in (0, mid)):
                tries.append((mid, COST_MERGE, "merge"))
            for t, c, action in tries:
                rank = ("keep", "merge", "relabel").index(action)
                new = (cost + c, rank, inserted, action)
                if t not in options or new < options[t]:
                    options[t] = new
        out[s] = [(t, c, inserted, action) for t, (c, _, inserted, action) in sorted(options.items())]
    return out


MOVES = {kind: _moves(kind) for kind in range(4)}


def forward(costs: list[int], kinds: list[int]) -> tuple[list[int], list[list[int]]]:
    """Costs per state after the turns, and for each turn and state the state before it (-1: out of reach)."""
    back = []
    for kind in kinds:
        fresh, came = [INFINITE] * 4, [-1] * 4
        for s in range(4):
            if costs[s] < INFINITE:
                for t, c, _, _ in MOVES[kind][s]:
                    if costs[s] + c < fresh[t]:
                        fresh[t], came[t] = costs[s] + c, s
        costs = fresh
        back.append(came)
    return costs, back


def final_costs(costs: list[int]) -> list[int]:
    """Costs with the insertions that reach the assistant's state added."""
    return [c + INSERTIONS[s, ASSISTANT][0] if (s, ASSISTANT) in INSERTIONS and c < INFINITE else INFINITE for s, c in enumerate(costs)]


def path_states(kinds: list[int], begin: int, end: int | None) -> list[int]:
    """States before the first turn and after each turn, from ``begin`` to ``end`` (None: the cheapest legal end)."""
    costs, back = forward([0 if s == begin else INFINITE for s in range(4)], kinds)
    if end is None:
        last = final_costs(costs)
        end = last.index(min(last))
    states = [end]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def repair(kinds: list[int], begin: int = START, end: int | None = None, last: bool = True) -> list[list[tuple[int, str]]]:
    """For every turn its (state, action) steps in order: insertions before it, itself, and insertions at the very end."""
    states = path_states(kinds, begin, end)
    out = []
    for kind, s, t in zip(kinds, states, states[1:], strict=False):
        inserted, action = next((i, a) for u, _, i, a in MOVES[kind][s] if u == t)
        out.append([*((x, "insert") for x in inserted), (t, action)])
    if last and out:
        out[-1] += [(x, "insert") for x in INSERTIONS[states[-1], ASSISTANT][1]]
    return out


OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
    """Consecutive rows of one conversation inside a task, joined over batch borders."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        key = batch["conv_id"].astype("object").where(batch["conv_id"].notna(), None)
        run = (key != key.shift()) & ~(key.isna() & key.shift().isna())
        run.iloc[0] = False
        for _, part in batch.groupby(run.cumsum(), sort=False):
            same = held and _same(held[-1]["conv_id"].iloc[0], part["conv_id"].iloc[0])
            if held and not same:
                yield held[0]["conv_id"].iloc[0], pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0]["conv_id"].iloc[0], pd.concat(held, ignore_index=True)


def _same(a: object, b: object) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def _matrix(kinds: list[int]) -> list[list[int]]:
    return [forward([0 if s == b else INFINITE for s in range(4)], kinds)[0] for b in range(4)]


def _border_states(pieces: list[tuple[int, int, object, list[list[int]]]]) -> dict[tuple[int, int], tuple[int, int | None, bool, bool]]:
    """(task, 0 for its first piece, 1 for its last) -> (state before, state after, begins, ends) from the pieces in order."""
    out = {}
    for _, group in itertools.groupby(pieces, key=_Key):
        chain = list(group)
        ahead = [[0 if s == START else INFINITE for s in range(4)]]
        for _, _, _, m in chain:
            ahead.append([min(min(ahead[-1][s] + m[s][t] for s in range(4)), INFINITE) for t in range(4)])
        last = final_costs(ahead[-1])
        state = last.index(min(last))
        for k in range(len(chain) - 1, -1, -1):
            m, after = chain[k][3], state
            totals = [ahead[k][s] + m[s][after] for s in range(4)]
            state = totals.index(min(totals))
            out[chain[k][0], chain[k][1]] = (state, after, k == 0, k == len(chain) - 1)
    return out


class _Key:
    """Conversation of a piece; two nulls are the same."""

    def __init__(self, piece: tuple[int, int, object, list[list[int]]]):
        self.key = piece[2]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Key) and _same(self.key, other.key)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired sequence of ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    One row per source turn and per inserted turn: (conv_id, position, turn, part, source_role, role, action, rendered).
    ``position`` increases with the source turns (not densely), ``part`` orders the rows of a source turn (insertions before it,
    the turn, insertions after the last). Joining ``rendered`` by position and part gives the rendered conversation. Turns are ordered by turn, then role, then text, nulls first, so rows that
    repeat a turn number, even whole rows, are turns of their own. A null text is empty, a role that is null or not
    known is relabelled at little cost or merged. Null conv_ids form one conversation. An empty table gives an empty result.
    """
    order = ["conv_id", "turn", "role", "text"]
    ranged = cut(conversations.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)).withColumns(
        {"task": F.spark_partition_id(), "position": F.monotonically_increasing_id()}
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = final = None
        number = 0
        for number, (conv, rows) in enumerate(_pieces(batches), 1):
            final = (int(rows["task"].iloc[0]), conv, [role_state(r) for r in rows["role"]])
            first = first or final
        for which, piece in ((0, first), (1, final)):
            if piece and (which == 0 or number > 1):
                yield pd.DataFrame([{"task": piece[0], "which": which, "conv_id": piece[1], "costs": [c for r in _matrix(piece[2]) for c in r]}])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    summary = ranged.select("conv_id", "role", "task").mapInPandas(
        summarise, f"task int, which int, conv_id {kind}, costs array<bigint>"
    )
    pieces = [(r["task"], r["which"], r["conv_id"], [r["costs"][4 * i : 4 * i + 4] for i in range(4)]) for r in summary.collect()]  # two a task
    borders = _border_states(sorted(pieces, key=lambda p: p[:2]))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        number = 0
        for number, (_, rows) in enumerate(_pieces(batches), 1):
            if held is not None:
                yield render(held, 0 if number == 2 else None)
            held = rows
        if held is not None:
            yield render(held, 0 if number == 1 else 1)

    def render(rows: pd.DataFrame, which: int | None) -> pd.DataFrame:
        kinds = [role_state(r) for r in rows["role"]]
        begin, end, begins, ends = START, None, True, True
        if which is not None:
            begin, end, begins, ends = borders[int(rows["task"].iloc[0]), which]
        out = []
        steps = repair(kinds, begin, end, ends)
        opened = not begins
        for i, (conv, at, turn, role, text, own) in enumerate(
            zip(rows["conv_id"], rows["position"], rows["turn"], rows["role"], rows["text"], steps, strict=True)
        ):
            for part, (state, action) in enumerate(own):
                body = "" if action == "insert" or pd.isna(text) else text
                lead = "\n" if action == "merge" else (CLOSE if opened else "") + OPEN.format(STATE_ROLE[state])
                opened = True
                last = CLOSE if ends and i == len(steps) - 1 and part == len(own) - 1 else ""
                out.append((conv, at, turn, part, None if action == "insert" else role, STATE_ROLE[state], action, lead + body + last))
        return pd.DataFrame(out, columns=["conv_id", "position", "turn", "part", "source_role", "role", "action", "rendered"])

    turn_kind = conversations.schema["turn"].dataType.simpleString()
    return ranged.mapInPandas(
        mend, f"conv_id {kind}, position bigint, turn {turn_kind}, part int, source_role string, role string, action string, rendered string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_turns(table(spark, sf_dir, "conversations"))
