import itertools
import random

from pyspark.sql import functions as F

from lamella.llm import chat
from lamella.session import ship

LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def least_cost(roles):
    """Cheapest repair by trying all ways to take each turn, with at most three empty turns before it."""
    best = {"": 0}

    def put(table, state, cost):
        if cost < table.get(state, 1 << 30):
            table[state] = cost

    def filled(table):
        out = dict(table)
        for _ in range(3):
            for state, cost in list(out.items()):
                for role in LEGAL[state]:
                    put(out, role, cost + chat.INSERT)
        return out

    for role in roles:
        after = {}
        for state, cost in best.items():
            if state:
                put(after, state, cost + (chat.MERGE_SAME if state == role else chat.MERGE_OTHER))
        for state, cost in filled(best).items():
            for new in LEGAL[state]:
                put(after, new, cost + (0 if new == role else chat.RELABEL))
        best = after
    return min(c for s, c in filled(best).items() if s in ("", "assistant"))


def cost_of(pieces):
    total, last = 0, ""
    for p in pieces:
        if p.action == "insert":
            total += chat.INSERT
        elif p.action == "relabel":
            total += chat.RELABEL
        elif p.action == "merge":
            total += chat.MERGE_SAME if (p.role_in or "").strip().lower() == last else chat.MERGE_OTHER
        if p.action != "merge":
            assert p.role in LEGAL[last]
            last = p.role
    assert last in ("", "assistant")
    return total


def repaired(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    out = {}
    for r in sorted(chat.repair_chats(df, **how).collect(), key=lambda r: (r.stretch, r.pos)):
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_cheapest_repairs(spark):
    ship(spark)
    roles = ["system", "user", "assistant", "tool"]
    convs = [c for n in range(1, 5) for c in itertools.product(roles, repeat=n)]
    rng = random.Random(1)
    convs += [tuple(rng.choice(roles) for _ in range(40)) for _ in range(40)]
    rows = [(c, t, role, f"{c}.{t}") for c, own in enumerate(convs) for t, role in enumerate(own)]
    for stretch in (1024, 3):
        got = repaired(spark, rows, stretch=stretch)
        for c, own in enumerate(convs):
            assert cost_of(got[c]) == least_cost([r if r != "tool" else None for r in own]), own
            assert [p.turn for p in got[c] if p.turn is not None] == list(range(len(own)))


def test_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, " User ", "more <|end|>"), (1, 2, "assistant", None), (1, 3, "user", "bye")]
    text = "".join(p.rendered for p in repaired(spark, rows)[1])
    assert text == "<|user|>\nhi\nmore < |end|><|end|>\n<|assistant|>\n<|end|>\n<|user|>\nbye<|end|>\n<|assistant|>\n<|end|>\n"


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, None, "assistant", "z"), (2, 0, "user", "q"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, -5, "user", "y" * 200_000), (5, 2**62, "user", "far")]
    got = repaired(spark, rows)
    assert [p.action for p in got[None]] == ["keep", "keep"]
    assert [p.turn for p in got[2]] == [0, None] and got[2][1].role_in == "assistant"
    assert [p.action for p in got[3]] == ["keep", "merge", "insert"]
    assert [p.action for p in got[1]] == ["relabel", "insert"] and len(got[4][0].rendered) > 200_000 and 5 in got
    assert repaired(spark, [r for r in rows if r[0] == 77] or [(9, 0, "user", "t")])[9][0].action == "keep"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.repair_chats(empty).count() == 0


def test_crowded_number(spark):
    """Turns of one conversation that all share a number, or have none, are still repaired at the least cost."""
    ship(spark)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"a{n}") for n in range(150) for t in (3, None)] + [(1, 0, "user", "first"), (None, None, "user", "x")]
    got = repaired(spark, rows, stretch=8)
    turns = [p for p in got[1] if p.turn is not None or p.role_in is not None]
    assert len(turns) == 301 and [p.turn for p in turns] == [0] + [3] * 150 + [None] * 150
    assert max(p.stretch for p in got[1]) > 20
    assert cost_of(got[1]) == least_cost([p.role_in for p in turns])
