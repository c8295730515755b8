"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn and then pairs of a user and an
assistant turn. Each input turn is kept, relabelled or merged into the turn
before, and empty turns may be put in; a dynamic program over the automaton's
states finds the cheapest repair, and the repaired sequence is rendered.

Costs add up along a conversation, so a stretch of it is a small matrix of least
costs from state to state, and matrices of successive stretches multiply (least
sum for product). Conversations are cut into stretches by turn number, and a
crowded stretch, as of turns that share a number, by a hash of role and text;
every stretch's matrix, then the states between stretches, then the steps within
them are found by stretch, so no task holds a whole long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import bounded, cut

#: States: nothing yet, or the role of the last turn. A conversation ends with nothing or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (START, ASSISTANT)

#: Costs of steps. Merging turns of one role is the cheapest repair, merging others the dearest.
INSERT, RELABEL, MERGE_SAME, MERGE_OTHER = 2, 3, 1, 6
FAR = 1 << 40
#: Turn numbers of one stretch.
STRETCH = 1024
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _fillers() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each two states the fewest empty turns that lead from one to the other, the last one included."""
    out = {}
    for a in range(4):
        seen, queue = {a: ()}, [a]
        for s in queue:
            for t in NEXT[s]:
                if t not in seen:
                    seen[t] = (*seen[s], t)
                    queue.append(t)
        for t, path in seen.items():
            out[a, t] = path
    return out


_PATHS = _fillers()


def steps(role: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """All ways (from, to, cost, action, empty turns before) to take in one turn; earlier ones win ties."""
    out = []
    for s in range(4):
        if s != START and role is not None:
            out.append((s, s, MERGE_SAME if role == s else MERGE_OTHER, "merge", ()))
        elif s != START:
            out.append((s, s, MERGE_OTHER, "merge", ()))
        for t in (SYSTEM, USER, ASSISTANT):
            for before in range(4):
                if t in NEXT[before] and (s, before) in _PATHS:
                    empty = _PATHS[s, before]
                    out.append((s, t, len(empty) * INSERT + (0 if role == t else RELABEL), "keep" if role == t else "relabel", empty))
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda x: (x[0], x[1], x[2], rank[x[3]], x[4]))


_BEST: dict[int | None, dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]] = {}
for _role in (None, SYSTEM, USER, ASSISTANT):
    _own: dict = {}
    for _s, _t, _cost, _action, _empty in steps(_role):
        _own.setdefault((_s, _t), (_cost, _action, _empty))
    _BEST[_role] = _own


def role_of(name: str | None) -> int | None:
    return ROLES.get((name or "").strip().lower())


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a conversation in this state."""
    return min(((len(_PATHS[state, e]) * INSERT, _PATHS[state, e]) for e in ENDS if (state, e) in _PATHS), key=lambda x: (x[0], x[1]))


def advance(costs: list[int], role: int | None) -> tuple[list[int], list[int]]:
    """Least costs by state after one more turn, and the state each came from; the smaller state wins ties."""
    after, came = [FAR] * 4, [-1] * 4
    for (s, t), (cost, _, _) in _BEST[role].items():
        if costs[s] + cost < after[t] or (costs[s] + cost == after[t] and s < came[t]):
            after[t], came[t] = costs[s] + cost, s
    return after, came


def matrix(roles: list[int | None]) -> list[int]:
    """Least costs of a stretch, from state by state, row by row."""
    out = []
    for s in range(4):
        costs = [0 if x == s else FAR for x in range(4)]
        for role in roles:
            costs, _ = advance(costs, role)
        out += [min(c, FAR) for c in costs]
    return out


def path(roles: list[int | None], begin: int, end: int) -> list[int]:
    """States after each turn of a cheapest way from ``begin`` to ``end``."""
    costs, back = [0 if x == begin else FAR for x in range(4)], []
    for role in roles:
        costs, came = advance(costs, role)
        back.append(came)
    out = [end]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1][1:]


def joints(matrices: list[list[int]]) -> list[int]:
    """States between the stretches of a conversation: before the first, after each."""
    costs, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        totals = [[costs[s] + m[4 * s + t] for s in range(4)] for t in range(4)]
        back.append([min(range(4), key=lambda s, own=own: (own[s], s)) for own in totals])
        costs = [min(own) for own in totals]
    end = min(range(4), key=lambda t: (costs[t] + closing(t)[0], t))
    out = [end]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def _shown(text: str | None) -> str:
    """A text that can't be taken for a mark of the format."""
    return (text or "").replace("<|", "< |")


def render(turns: list[tuple], begin: int, end: int, last: bool) -> list[tuple]:
    """(turn, role before, role, action, rendered) for each piece of a stretch, empty turns included."""
    roles = [role_of(r) for _, r, _ in turns]
    state, out = begin, []

    def open_turn(role: int) -> str:
        nonlocal state
        head = ("" if state == START else CLOSE) + OPEN.format(NAMES[role])
        state = role
        return head

    for (turn, name, text), role, after in zip(turns, roles, path(roles, begin, end)):
        _, action, empty = _BEST[role][state, after]
        for e in empty:
            out.append((None, None, NAMES[e], "insert", open_turn(e)))
        if action == "merge":
            out.append((turn, name, NAMES[state], action, "\n" + _shown(text)))
        else:
            out.append((turn, name, NAMES[after], action, open_turn(after) + _shown(text)))
    if last:
        for e in closing(state)[1]:
            out.append((None, None, NAMES[e], "insert", open_turn(e)))
        if out:
            out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, list[int]] = {}
        out = []
        for names in batch.column(3).to_pylist():
            roles = tuple(role_of(n) for n in names)
            if roles not in known:
                known[roles] = matrix(list(roles))
            out.append(known[roles])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["conv", "whole", "fine", "costs"])


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for own in batch.column(1).to_pylist():
            own.sort(key=lambda x: (x["whole"], x["fine"]))
            at = joints([x["costs"] for x in own])
            out.append([{"whole": x["whole"], "fine": x["fine"], "stretch": n, "begin": at[n], "end": at[n + 1], "last": n + 1 == len(own)} for n, x in enumerate(own)])
        kind = pa.list_(pa.struct([("whole", pa.int64()), ("fine", pa.int64()), ("stretch", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["conv", "parts"])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        conv, out = [], []
        for n, (stretch, turns, begin, end, last) in enumerate(zip(*columns)):
            made = render([(t["turn"], t["role"], t["text"]) for t in turns], begin, end, last)
            conv += [n] * len(made)
            out += [(stretch, pos, *m) for pos, m in enumerate(made)]
        parts = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["conv", "stretch", "pos", "turn", "role_in", "role", "action", "rendered"]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(conv, pa.int64())), *[pa.array(p, k) for p, k in zip(parts, kinds)]], names)


def repair_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Repaired conversations by piece: ``conv_col``, stretch, pos, turn, role_in, role, action, rendered.

    A conversation's pieces in the order of stretch and pos, rendered end to end,
    are its formatted text. action is keep, relabel, merge (the piece goes on
    within the turn before) or insert (an empty turn; turn and role_in are null).

    Turns come by number, equal numbers by a hash of role and text, and turns
    without one after all others. Repeated rows are turns of their own; those
    that repeat one turn of one conversation are in one stretch. Roles are known
    in any case and with blanks around; others, null among them, must be
    relabelled or merged. A null text is as an empty one. Rows without a
    conversation's id are one conversation. The mark "<|" in a text becomes
    "< |". An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    number = F.col(turn_col).cast("long")
    within = F.pmod(number, F.lit(stretch).cast("long"))
    # Rounded down, and without overflow at either end.
    whole = F.when(number >= 0, F.call_function("div", number, F.lit(stretch))).otherwise(-F.call_function("div", -(number + 1), F.lit(stretch)) - 1)
    # 30 bits of a hash, in whose order turns of equal number come.
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))), 34)
    turn = F.struct(F.coalesce(number, F.lit(2**63 - 1)).alias("at"), tie.alias("tie"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), number.alias("turn"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.coalesce(whole, F.lit(2**62)).alias("whole"), F.coalesce(within, F.lit(0)).alias("within"), turn.alias("t"))
    # A crowded stretch is cut finer, by number and then by hash.
    crowded = cut(rows.groupBy("conv", "whole").count().where(F.col("count") > 4 * stretch).select(F.col("conv").alias("c"), F.col("whole").alias("w"), F.ceil(F.col("count") / stretch).alias("cuts")))
    rows = rows.join(bounded(crowded), F.col("conv").eqNullSafe(F.col("c")) & (F.col("whole") == F.col("w")), "left")
    fine = F.coalesce(F.col("within") * F.col("cuts") + F.shiftright(F.col("t.tie") * F.col("cuts"), 30), F.lit(0))
    parts = cut(rows.withColumn("fine", fine).groupBy("conv", "whole", "fine").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    kind = parts.schema["conv"].dataType.simpleString()
    costs = parts.select("conv", "whole", "fine", F.col("turns.role").alias("roles")).mapInArrow(_matrices, f"conv {kind}, whole long, fine long, costs array<long>")
    chains = costs.groupBy("conv").agg(F.collect_list(F.struct("whole", "fine", "costs")).alias("parts"))
    found = chains.mapInArrow(_joints, f"conv {kind}, parts array<struct<whole:long,fine:long,stretch:long,begin:int,end:int,last:boolean>>").select(F.col("conv").alias("c"), F.inline("parts"))
    found = found.select("c", F.col("whole").alias("w"), F.col("fine").alias("f"), "stretch", "begin", "end", "last")
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("whole") == F.col("w")) & (F.col("fine") == F.col("f"))
    ready = parts.join(found, here).select("conv", "stretch", "turns", "begin", "end", "last")
    out = ready.mapInArrow(_rendered, f"conv {kind}, stretch long, pos int, turn long, role_in string, role string, action string, rendered string")
    return out.withColumnRenamed("conv", conv_col)
