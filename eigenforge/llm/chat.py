"""Chat formatting with minimum-cost role repair (operator 8).

A legal conversation is an optional system turn, then user and assistant turns in alternation, from user to assistant.
Dynamic programming over the automaton of legal turns picks, for each turn, the role it gets and whether it joins the
turn before or has an empty turn put in front, at the least total cost; the repaired sequence is then rendered.

The cost of a run of turns is a matrix over the automaton's states, and matrices of neighbouring runs multiply (with
min and plus). So turns are range-partitioned by conversation and turn, and a conversation of any length may lie across
tasks: the driver multiplies one matrix for each task that a conversation crosses, and each task then solves its own run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.session import shared_dir, ship_package, shuffle_partitions

#: States: the role of the last turn so far. Roles have the same numbers; 0 is a role of no known name.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
INF = 1 << 40


@dataclass(frozen=True)
class Costs:
    relabel: int = 2
    merge: int = 1
    insert: int = 3


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"

    def escape(self, text: str) -> str:
        """Markers within a text are broken up, so that no text can end its own turn."""
        for mark in (self.begin, self.end):
            text = text.replace(mark, mark[:1] + "​" + mark[1:])
        return text

    def head(self, role: int) -> str:
        return f"{self.begin}{NAMES[role]}\n"

    def tail(self) -> str:
        return f"{self.end}\n"


def role_number(name) -> int:
    name = name.strip().lower() if isinstance(name, str) else ""
    return NAMES.index(name) if name in NAMES[1:] else 0


def bridge(state: int, role: int) -> tuple[int, ...] | None:
    """Empty turns to put between a state and a turn of that role; None if none make it legal."""
    if role == SYSTEM:
        return () if state == START else None
    if role == USER:
        return (ASSISTANT,) if state == USER else ()
    return () if state == USER else (USER,)


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that complete a conversation."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


class Automaton:
    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        #: cost[role][state][next state], and whether the turn merges there
        self.cost = [[[INF] * 4 for _ in range(4)] for _ in range(4)]
        self.merges = [[False] * 4 for _ in range(4)]
        for state in range(4):
            for new in (SYSTEM, USER, ASSISTANT):
                between = bridge(state, new)
                apart = INF if between is None else costs.insert * len(between)
                joined = costs.merge if new == state else INF
                self.merges[state][new] = joined <= apart and joined < INF
                step = min(apart, joined)
                for role in range(4):
                    self.cost[role][state][new] = min(INF, step + (0 if role == new else costs.relabel))
        self.end = [costs.insert * len(ending(s)) for s in range(4)]
        #: For a role, the next states in order of preference among equal costs: the role's own first.
        self.order = [sorted((SYSTEM, USER, ASSISTANT), key=lambda s, r=r: (s != r, -s)) for r in range(4)]

    def before(self, role: int, after: list[int]) -> list[int]:
        """Least cost to the end from each state in front of a turn, from those behind it."""
        return [min(INF, *(row[s] + after[s] for s in (1, 2, 3))) for row in self.cost[role]]

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Cost of a run from each state to each state."""
        columns = [[0 if s == t else INF for s in range(4)] for t in range(4)]  # cost to end in t
        for role in reversed(roles):
            columns = [self.before(role, c) for c in columns]
        return [[columns[t][s] for t in range(4)] for s in range(4)]

    def solve(self, roles: list[int], state: int, after: list[int]) -> list[int]:
        """The states a run goes through from a state, given the costs behind the run; ties by `order`."""
        rest = [after]
        for role in reversed(roles):
            rest.append(self.before(role, rest[-1]))
        path = []
        for role in roles:
            rest.pop()
            behind = rest[-1]
            row = self.cost[role][state]
            state = min(self.order[role], key=lambda s: row[s] + behind[s])
            path.append(state)
        return path


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
    """Consecutive rows of one conversation, joined across batches."""
    held: list[pd.DataFrame] = []
    key: object = None
    for pdf in batches:
        ids = pdf["conv_id"].astype("Int64")
        before = ids.shift()
        change = (ids.isna() != before.isna()) | (ids != before).fillna(False)
        change.iloc[0] = False
        for _, run in pdf.groupby(change.cumsum(), sort=False):
            k = None if pd.isna(run["conv_id"].iloc[0]) else int(run["conv_id"].iloc[0])
            if held and k != key:
                yield key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(run)
            key = k
    if held:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


def _chains(pieces: list[tuple]) -> list[list[tuple[int, str]]]:
    """Runs of one conversation in several parts: lists of (part, which of its ends)."""
    chains: list[list[tuple[int, str]]] = []
    open_chain: list[tuple[int, str]] = []
    last = None
    for part, first_id, last_id, runs in sorted(pieces, key=lambda p: p[0]):
        if open_chain and (first_id,) == last:
            open_chain.append((part, "first"))
            if runs > 1:
                chains.append(open_chain)
                open_chain = [(part, "last")]
        else:
            chains.append(open_chain)
            if runs > 1:
                chains.append([(part, "first")])
            open_chain = [(part, "last")]
        last = (last_id,)
    return [c for c in [*chains, open_chain] if len(c) > 1]


_OUT = "conv_id long, turn long, role string, text string, out_role string, action string, inserted string, cost long, piece string"


def format_turns(spark: SparkSession, turns: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """Each turn with its repair: conv_id, turn, role, text, out_role, action, inserted, cost, piece.

    action is keep, relabel, merge or relabel+merge; inserted names the empty turns put in front, and behind the last
    turn after a slash. The pieces of a conversation, joined in order, are its rendered text. Turns are ordered by turn
    (null first), role and text; repeated turns stay turns of their own. Unknown or null roles are relabelled, null
    texts are empty, and null conv_ids are one conversation. An empty table gives none. A task holds the turns of one
    conversation that are in its own partition at most.
    """
    ship_package(spark)
    shared_dir(spark)
    auto = Automaton(costs)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("tie").checkpoint()
    roles = dealt.select("conv_id", "role")

    def numbers(run: pd.DataFrame) -> list[int]:
        return [role_number(r) for r in run["role"]]

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs, first, last = TaskContext.get().partitionId(), 0, None, None
        for key, run in _runs(batches):
            runs += 1
            last = (key, run)
            first = first or last
        if runs:
            m = [sum(auto.matrix(numbers(run)), []) for run in (first[1], last[1])]
            yield pd.DataFrame({"part": [part], "first_id": pd.array([first[0]], dtype="Int64"), "last_id": pd.array([last[0]], dtype="Int64"), "runs": [runs], "first_m": [m[0]], "last_m": [m[1]]})

    seen = map_frames(roles, summary, "part int, first_id long, last_id long, runs long, first_m array<long>, last_m array<long>").collect()
    matrices = {(r["part"], end): r[f"{end}_m"] for r in seen for end in ("first", "last")}
    matrices |= {(r["part"], "last"): r["first_m"] for r in seen if r["runs"] == 1}
    chains = _chains([(r["part"], r["first_id"], r["last_id"], r["runs"]) for r in seen])
    behind: dict[tuple[int, str], list[int]] = {}  # for a run that goes on elsewhere: least cost behind it by state
    for chain in chains:
        after = auto.end
        for piece in reversed(chain):
            behind[piece] = after
            m = matrices[piece]
            after = [min(INF, *(m[4 * s + t] + after[t] for t in range(4))) for s in range(4)]

    def piece_of(part: int, number: int, is_last: bool) -> tuple[int, str] | None:
        names = [(part, "first")] if number == 0 else []
        names += [(part, "last")] if is_last else []
        return next((p for p in names if p in behind), None)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bool, pd.DataFrame]]:
        held, number = None, 0
        for _, run in _runs(batches):
            if held is not None:
                yield number, False, held
                number += 1
            held = run
        if held is not None:
            yield number, True, held

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, is_last, run in numbered(batches):
            piece = piece_of(part, number, is_last)
            if piece:
                yield pd.DataFrame({"part": [part], "end": [piece[1]], "to": [[auto.solve(numbers(run), s, behind[piece])[-1] for s in range(4)]]})

    entry: dict[tuple[int, str], int] = {}
    if chains:
        to = {(r["part"], r["end"]): r["to"] for r in map_frames(roles, exits, "part int, end string, to array<int>").collect()}
        for chain in chains:
            state = START
            for piece in chain:
                entry[piece] = state
                state = to[piece][state]
    ends = {c[-1] for c in chains}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, is_last, run in numbered(batches):
            piece = piece_of(part, number, is_last)
            wanted = numbers(run)
            start = entry[piece] if piece else START
            path = auto.solve(wanted, start, behind[piece] if piece else auto.end)
            closes = piece is None or piece in ends
            yield _render(auto, template, run, wanted, start, path, closes)

    return map_frames(dealt, solve, _OUT)


def _render(auto: Automaton, template: Template, run: pd.DataFrame, wanted: list[int], state: int, path: list[int], closes: bool) -> pd.DataFrame:
    out_role, action, inserted, cost, pieces = [], [], [], [], []
    for at, (role, new, text) in enumerate(zip(wanted, path, run["text"])):
        merged = auto.merges[state][new]
        between = () if merged else bridge(state, new)
        piece = "" if state == START else "\n" if merged else template.tail()
        piece += "".join(template.head(r) + template.tail() for r in between)
        piece += ("" if merged else template.head(new)) + template.escape(text if isinstance(text, str) else "")
        price = auto.cost[role][state][new]
        names = ",".join(NAMES[r] for r in between)
        if closes and at == len(path) - 1:
            more = ending(new)
            piece += template.tail() + "".join(template.head(r) + template.tail() for r in more)
            price += auto.costs.insert * len(more)
            names += "/" + ",".join(NAMES[r] for r in more) if more else ""
        out_role.append(NAMES[new])
        action.append("+".join(w for w, yes in (("relabel", role != new), ("merge", merged)) if yes) or "keep")
        inserted.append(names)
        cost.append(price)
        pieces.append(piece)
        state = new
    return pd.DataFrame({"conv_id": run["conv_id"], "turn": run["turn"], "role": run["role"], "text": run["text"], "out_role": out_role, "action": action, "inserted": inserted, "cost": cost, "piece": pieces})


def digests(spark: SparkSession, turns: DataFrame) -> DataFrame:
    out = format_turns(spark, turns)
    return out.select("conv_id", "turn", "role", "out_role", "action", "inserted", "cost", F.length("piece").cast("long").alias("piece_chars"), F.md5(F.encode("piece", "UTF-8")).alias("piece_md5"))
