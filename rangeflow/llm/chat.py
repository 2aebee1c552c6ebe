"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant.  Dynamic
programming over that automaton chooses, for each turn, its role (kept or relabelled), whether it merges with the turn before,
and which empty turns to insert; then the repaired turns are rendered.

Turns are range-partitioned by conversation and turn, so a conversation of any length is cut into fragments.  A fragment acts
on the automaton as a small min-plus matrix; the matrices of the one or two conversations that cross a partition's ends fix
the states there, and every fragment is then solved on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.store import shared_folder

#: States: nothing yet, or the role of the last repaired turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Role names that mean the same.
ALIASES = {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
#: Bytes of turns in one range.
RANGE_BYTES = 32 << 20
#: Costs of a repair.
MERGE, INSERT, RELABEL, RELABEL_SYSTEM, NAME_UNKNOWN = 1.0, 1.5, 2.0, 3.0, 0.5
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Empty turns that make a step legal, and those that end a conversation.
_FILL = {(START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,)}
_CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def state_of(role: str | None) -> int:
    """The state a role name stands for; 0 for null and unknown names."""
    return ALIASES.get((role or "").strip().lower(), 0)


def _steps(seen: int) -> list[tuple[int, int, float, bool, tuple[int, ...]]]:
    """(state before, state after, cost, merged, inserted) of the ways to take a turn with this role."""
    out = []
    for before in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            cost = 0.0 if role == seen else NAME_UNKNOWN if not seen else RELABEL_SYSTEM if SYSTEM in (role, seen) else RELABEL
            if before == role:
                out.append((before, role, cost + MERGE, True, ()))
            if (before, role) in _LEGAL:
                out.append((before, role, cost, False, ()))
            elif (before, role) in _FILL:
                out.append((before, role, cost + INSERT * len(_FILL[before, role]), False, _FILL[before, role]))
    return out


_STEPS = [_steps(seen) for seen in range(4)]
_END = np.array([INSERT * len(_CLOSE[s]) for s in range(4)])


def _matrix(seen: int) -> np.ndarray:
    m = np.full((4, 4), np.inf)
    for before, after, cost, _, _ in _STEPS[seen]:
        m[before, after] = min(m[before, after], cost)
    return m


_MATRIX = [_matrix(seen) for seen in range(4)]


def compose(seen: list[int]) -> np.ndarray:
    """The least cost from each state to each state over a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for s in seen:
        total = (total[:, :, None] + _MATRIX[s][None]).min(axis=1)
    return total


def repair(seen: tuple[int, ...], entry: int = START, leave: int | None = None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, inserted before) of each turn, at least cost from the entry state to the leaving one (None: to a legal end).

    Of equal costs the first way in the order of states is taken.
    """
    cost = [0.0 if s == entry else np.inf for s in range(4)]
    back = []
    for s in seen:
        best: list = [(np.inf, None)] * 4
        for step in _STEPS[s]:
            c = cost[step[0]] + step[2]
            if c < best[step[1]][0]:
                best[step[1]] = (c, step)
        cost = [c for c, _ in best]
        back.append([step for _, step in best])
    state = leave if leave is not None else int(np.argmin(np.array(cost) + _END))
    out = []
    for steps in reversed(back):
        before, role, _, merged, inserted = steps[state]
        out.append((role, merged, inserted))
        state = before
    return out[::-1]



def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch, bool]]:
    """The rows of each conversation of a sorted partition: (key, rows, whether it is the partition's last)."""
    key, held = None, []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        a = 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[a]:
                if held and ids[a] != key:
                    yield key, pa.Table.from_batches(held), False
                    held = []
                key = ids[a]
                held.append(batch.slice(a, k - a))
                a = k
    if held:
        yield key, pa.Table.from_batches(held), True


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and last conversation of a partition."""
    part, first = TaskContext.get().partitionId(), True
    for key, rows, last in _runs(batches):
        if first or last:
            cost = compose([state_of(r) for r in rows.column(2).to_pylist()]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key], rows.schema.field(0).type), pa.array([cost.tolist()])], names=["part", "conv", "cost"])
        first = False


def _boundaries(ends: list) -> dict[tuple[int, object], tuple[int, int | None]]:
    """Entry and leaving state of each fragment of the conversations that lie in several partitions."""
    by_key: dict = {}
    for r in ends:
        by_key.setdefault(r["conv"], []).append((r["part"], np.array(r["cost"]).reshape(4, 4)))
    out = {}
    for key, parts in by_key.items():
        if len(parts) < 2:
            continue
        parts.sort(key=lambda p: p[0])
        cost, back = np.where(np.arange(4) == START, 0.0, np.inf), []
        for _, m in parts:
            total = cost[:, None] + m
            back.append(total.argmin(axis=0))
            cost = total.min(axis=0)
        state = int((cost + _END).argmin())
        for k in range(len(parts) - 1, -1, -1):
            entry = int(back[k][state])
            out[parts[k][0], key] = (entry, None if k == len(parts) - 1 else state)
            state = entry
    return out


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_SHUT = "<|im_end|>\n"


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per input turn: the conversation, the turn, ``seen_role``, ``role``, ``action`` (keep, relabel, merge, relabel+merge),
    ``inserted`` (roles of empty turns before it), ``appended`` (after a conversation's last turn) and ``rendered``.

    The ``rendered`` pieces of a conversation in order of turns are its chat text.  Turns go by number, then role, then a hash of
    the text (nulls first); rows with a null conversation are one conversation; null text is empty; a null or unknown role is
    free to be any.  Rows are numbered before they are dealt out, so a conversation of any length, a turn that many rows share,
    and repeated rows are cut into ranges like all others.  An empty table gives no rows; other columns are left out.
    """
    spark = conversations.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    columns = [conv_col, turn_col, role_col, text_col]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    ranges = max(spark.sparkContext.defaultParallelism, (conversations.agg(F.sum(size)).first()[0] or 0) // RANGE_BYTES)
    numbered = conversations.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).withColumns({"h": F.xxhash64("c3"), "row": F.monotonically_increasing_id()})
    order = ["c0", "c1", "c2", "h", "row"]
    dealt = numbered.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = dealt.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]).checkpoint()
    kinds = dict(rows.dtypes)
    ends = rows.mapInArrow(_ends, f"part int, conv {kinds[conv_col]}, cost array<double>").collect()  # two small rows per partition
    shared = spark.sparkContext.broadcast(_boundaries(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, states = TaskContext.get().partitionId(), shared.value
        known = lru_cache(maxsize=1 << 14)(repair)  # short conversations repeat their sequences of roles
        held, size = [], 0
        for key, table, _ in _runs(batches):
            entry, leave = states.get((part, key), (START, None))
            roles, texts = table.column(2).to_pylist(), table.column(3).to_pylist()
            seen = tuple(state_of(r) for r in roles)
            chosen = (known if len(seen) <= 64 else repair)(seen, entry, leave)
            actions, out_roles, inserted, appended, rendered = [], [], [], [], []
            begun = entry != START
            for k, ((role, merged, added), s, text) in enumerate(zip(chosen, seen, texts, strict=True)):
                actions.append("+".join([*(["relabel"] if role != s else []), *(["merge"] if merged else [])]) or "keep")
                closing = _CLOSE[role] if leave is None and k == len(seen) - 1 else ()
                body = "\n\n" if merged else "".join([_SHUT if begun else "", *[_open(a) + _SHUT for a in added], _open(role)])
                body += text or ""
                if leave is None and k == len(seen) - 1:
                    body += _SHUT + "".join(_open(a) + _SHUT for a in closing)
                out_roles.append(ROLES[role])
                inserted.append([ROLES[a] for a in added])
                appended.append([ROLES[a] for a in closing])
                rendered.append(body)
                begun = True
            names = [conv_col, turn_col, "seen_role", "role", "action", "inserted", "appended", "rendered"]
            lists = pa.list_(pa.string())
            held.append(pa.table([table.column(0), table.column(1), table.column(2), pa.array(out_roles), pa.array(actions), pa.array(inserted, lists), pa.array(appended, lists), pa.array(rendered)], names=names))
            size += len(seen)
            if size > 4096:
                yield from pa.concat_tables(held).to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).to_batches()

    schema = f"{conv_col} {kinds[conv_col]}, {turn_col} {kinds[turn_col]}, seen_role string, role string, action string, inserted array<string>, appended array<string>, rendered string"
    return rows.mapInArrow(run, schema)
