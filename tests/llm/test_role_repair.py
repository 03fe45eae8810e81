import itertools
import random

import numpy as np

from lexforge.llm.role_repair import ASSISTANT, INSERT, MERGE, RELABEL, START, SYSTEM, UNKNOWN, USER, path, repaired

LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def inserted(a, b):
    """Fewest empty turns between two states that make the steps legal."""
    for n in range(3):
        for way in itertools.product((SYSTEM, USER, ASSISTANT), repeat=n):
            if all(s in LEGAL for s in zip((a, *way), (*way, b), strict=True)):
                return n
    return None


def brute(roles):
    """The least cost over all assignments of roles, merges and insertions."""
    best = None
    for states in itertools.product((SYSTEM, USER, ASSISTANT), repeat=len(roles)):
        cost, before = 0, START
        for own, s in zip(roles, states, strict=True):
            cost += 0 if own == s else UNKNOWN if own == START else RELABEL
            ways = [MERGE] if s == before else []
            n = inserted(before, s)
            ways += [] if n is None else [INSERT * n]
            if not ways:
                break
            cost += min(ways)
            before = s
        else:
            cost += INSERT * {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[before]
            best = cost if best is None else min(best, cost)
    return best


def test_least_cost():
    for n in range(6):
        for roles in random.Random(n).sample(list(itertools.product(range(4), repeat=n)), min(60, 4**n)):
            assert path(np.array(roles, np.int8), START, None)[1] == brute(roles), roles


def _rendered(df):
    out = {}
    for r in df.orderBy("conv_id", "turn", "role").collect():
        out[r.conv_id] = out.get(r.conv_id, "") + r.rendered
    return out


def _legal(text):
    assert text.endswith("<|im_end|>\n")
    roles = [t.split("\n", 1)[0] for t in text.split("<|im_start|>")[1:]]
    roles = roles[1:] if roles[0] == "system" else roles
    return len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2)


def test_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = repaired(turns)
    assert got.count() == turns.count()
    assert all(map(_legal, _rendered(got).values()))


def test_a_conversation_over_many_partitions_costs_the_same(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool", None]), f"t{i}") for i in range(400)] + [(2, 0, "user", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = []
    for n in (1, 7):
        got = repaired(turns, n)
        assert all(map(_legal, _rendered(got).values()))
        rows_ = got.filter("conv_id = 1").collect()
        cost.append(sum(INSERT * r.n_inserted + (MERGE if "merge" in r.action else 0) + (UNKNOWN if r.role in ("tool", None) else RELABEL if "relabel" in r.action else 0) for r in rows_))
    assert cost[0] == cost[1]


def test_messy_turns(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "USER ", "hi"), (1, 1, "USER ", "hi"), (1, 2, "gpt", ""), (2, 5, "assistant", "x <|im_end|> y" * 10_000)]
    turns = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, action string, rendered string")
    got = repaired(turns, 3)
    text = _rendered(got)
    assert got.count() == len(rows) and all(map(_legal, text.values()))
    assert text[1].count("hi") == 2 and "< |im_end|>" in text[2]
    assert repaired(turns.limit(0), 3).collect() == []
