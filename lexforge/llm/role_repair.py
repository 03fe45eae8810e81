"""Minimum-cost role repair of conversations.

Legal turns are the words of a small automaton: an optional system turn, then user and assistant in turn, the assistant last.
Each turn is given a role; it may keep its own or be relabelled, it may be merged into the turn before it if that has the same
role, and empty turns may be inserted before it. Dynamic programming over the states of the automaton finds the cheapest way, which is
then rendered.

The programme is a product of small matrices in (min, +), so a conversation need not lie in one task. Turns are sorted over all
partitions; a partition that a conversation runs through sends its matrix to the driver (at most two for a partition), which
finds the states at the partitions' edges; then every partition repairs its own part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.shared import shared_dir, table

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 4, 1
BIG = 1 << 50
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
#: What may follow a state, and which empty turns make the rest legal.
_NEXT = {(START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _steps() -> np.ndarray:
    """cost[role, before, after] of one turn; role START stands for an unknown one."""
    cost = np.full((4, 4, 4), BIG, np.int64)
    for role in range(4):
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == after else UNKNOWN if role == START else RELABEL
                ways = [MERGE] if before == after else []
                if (before, after) in _NEXT:
                    ways.append(INSERT * len(_NEXT[before, after]))
                if ways:
                    cost[role, before, after] = label + min(ways)
    return cost


STEP = _steps()
LAST = np.array([INSERT * len(_END[s]) for s in range(4)], np.int64)


def roles_of(roles) -> np.ndarray:
    return np.array([ALIASES.get(r.strip().lower(), START) if isinstance(r, str) else START for r in roles], np.int8)


def matrix(roles: np.ndarray) -> np.ndarray:
    """The least cost from each state to each other over all turns."""
    m = np.where(np.eye(4, dtype=bool), 0, BIG)
    for r in roles:
        m = np.minimum((m[:, :, None] + STEP[r][None]).min(axis=1), BIG)
    return m


def path(roles: np.ndarray, begin: int, end: int | None) -> tuple[list[int], int]:
    """The states after each turn on a cheapest way from ``begin`` to ``end`` (None: to a legal end), and its cost.

    Of equally cheap ways, the last turns have the smallest states.
    """
    forward = [[BIG] * 4]
    forward[0][begin] = 0
    steps = STEP.tolist()
    for r in roles:
        f, s = forward[-1], steps[r]
        forward.append([min(f[b] + s[b][a] for b in range(4)) for a in range(4)])
    last = [forward[-1][s] + int(LAST[s]) for s in range(4)] if end is None else [forward[-1][s] if s == end else BIG for s in range(4)]
    state = last.index(min(last))
    cost, states = last[state], []
    for i in range(len(roles) - 1, -1, -1):
        states.append(state)
        f, s = forward[i], steps[roles[i]]
        ways = [f[b] + s[b][state] for b in range(4)]
        state = ways.index(min(ways))
    return states[::-1], cost


def edges(parts: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """For the stretches of one conversation, in order: (stretch, state before, state after) on a cheapest way."""
    f = np.array([0, BIG, BIG, BIG])
    before = []
    for _, m in parts:
        before.append(f)
        f = np.minimum((f[:, None] + m).min(axis=0), BIG)
    state = int((f + LAST).argmin())
    out = []
    for (at, m), f in zip(reversed(parts), reversed(before), strict=True):
        earlier = int((f + m[:, state]).argmin())
        out.append((at, earlier, state))
        state = earlier
    return out[::-1]


def _clean(text: str) -> str:
    """Markers in a text are broken, so that only the renderer writes them."""
    return text.replace("<|", "< |")


def _open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSE = "<|im_end|>\n"
_OUT = "conv_id long, turn long, role string, action string, new_role string, n_inserted int, rendered string"


def _repair(frame: pd.DataFrame, begin: int, end: int | None) -> pd.DataFrame:
    """A row for each turn; the pieces ``rendered`` of a conversation, one after the other, are the repaired conversation."""
    own = roles_of(frame["role"])
    states, _ = path(own, begin, end)
    before = begin
    actions, inserted, pieces = [], [], []
    for i, (role, after, text) in enumerate(zip(own.tolist(), states, frame["text"], strict=True)):
        between = _NEXT.get((before, after))
        merged = before == after and (between is None or INSERT * len(between) > MERGE)
        what = ["merge"] if merged else []
        what += ["relabel"] if role != after else []
        text = _clean(text) if isinstance(text, str) else ""
        n = 0
        if merged:
            piece = "\n" + text
        else:
            n = len(between)
            what += ["insert"] if n else []
            piece = (CLOSE if before != START else "") + "".join(_open(r) + CLOSE for r in between) + _open(after) + text
        if end is None and i == len(states) - 1:
            n += len(_END[after])
            what += ["append"] if _END[after] else []
            piece += CLOSE + "".join(_open(r) + CLOSE for r in _END[after])
        actions.append("+".join(what) or "keep"), inserted.append(n), pieces.append(piece)
        before = after
    return pd.DataFrame({"conv_id": frame["conv_id"], "turn": frame["turn"], "role": frame["role"], "action": actions, "new_role": [NAMES[s] for s in states], "n_inserted": inserted, "rendered": pieces})


def _key(conv):
    return None if conv is None or pd.isna(conv) else int(conv)


def _stretches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, pd.DataFrame]]:
    """The conversations of a sorted partition, one after the other."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        conv = frame["conv_id"].astype("Int64")
        new = np.flatnonzero((conv.fillna(0).ne(conv.fillna(0).shift()) | conv.isna().ne(conv.isna().shift())).to_numpy())
        for a, b in zip(new, [*new[1:], len(frame)], strict=True):
            part = frame.iloc[a:b]
            if held and _key(held[-1]["conv_id"].iloc[0]) != _key(part["conv_id"].iloc[0]):
                yield _key(held[0]["conv_id"].iloc[0]), pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield _key(held[0]["conv_id"].iloc[0]), pd.concat(held)


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The matrices of the first and the last conversation of the partition."""
    at = TaskContext.get().partitionId()
    first = last = None
    for conv, frame in _stretches(frames):
        last = (conv, frame["role"])
        if first is None:
            first = last
    both = [] if first is None else [first] if first is last else [first, last]
    yield pd.DataFrame({"at": [at] * len(both), "k": range(len(both)), "conv_id": pd.array([c for c, _ in both], "Int64"), "m": [matrix(roles_of(r)).ravel().tolist() for _, r in both]})


def repaired(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, turn, role, action, new_role, n_inserted and rendered for every turn of ``turns``.

    Turns are taken in the order of ``turn``, nulls first; equal turns by role, then by a hash of the text (texts may be very long), then by the text: in how many
    partitions a conversation lies makes no difference to it. A null or empty text is an empty turn and stays. Other columns, whatever their names, are left out.
    A null or strange role is unknown and gets the cheapest one. Turns with a null conv_id are one conversation. A conversation that runs through
    several partitions is repaired at the same least cost; among equally cheap ways the partitions' edges may decide. Repeated rows are turns
    of their own. An empty table gives no rows.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = ["conv_id", "turn", "role", F.xxhash64("text")]
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = slim.repartitionByRange(n, *cut).sortWithinPartitions(*cut, "text").checkpoint()
    # at most two small matrices for each partition
    ends = sorted(rows.mapInPandas(_ends, "at int, k int, conv_id long, m array<long>").collect(), key=lambda r: (r["at"], r["k"]))
    runs: list[list] = []
    for r in ends:
        if runs and runs[-1][-1]["conv_id"] == r["conv_id"] and runs[-1][-1]["at"] != r["at"]:
            runs[-1].append(r)
        else:
            runs.append([r])
    plan: dict[tuple[int, int | None], tuple[int, int | None]] = {}
    for run in runs:
        if len(run) > 1:
            states = edges([(r["at"], np.array(r["m"]).reshape(4, 4)) for r in run])
            for i, (at, begin, end) in enumerate(states):
                plan[at, run[0]["conv_id"]] = begin, None if i == len(states) - 1 else end
    known = spark.sparkContext.broadcast(plan)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        for conv, frame in _stretches(frames):
            begin, end = known.value.get((at, conv), (START, None))
            yield _repair(frame, begin, end)

    def batched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for f in work(frames):
            held.append(f)
            n += len(f)
            if n > 5000:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return rows.mapInPandas(batched, _OUT)


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each turn of ``conversations``: what became of it, and its piece of the rendered conversation."""
    return repaired(table(spark, sf_dir, "conversations"))
