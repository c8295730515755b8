"""Shards of equal bytes by histogram sort.

Rows are ordered by a pair of uniform 63-bit keys, the first from the text, the
second from the id, so equal texts lie together and still a large group of them
can be cut. The splitters between shards are found by counting: each round
counts exact bytes and rows between probes over all partitions, and refines the
probes inside those cells that hold a splitter, until every splitter is within
tolerance of its target. Then rows are exchanged once. Everything is DataFrame
expressions; the driver sees a few thousand counts a round at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut, drop

TOP = 2**63 - 1
#: Probes of one round, over all cells under refinement.
PROBES = 8192
#: Rows that one task numbers, about.
BLOCK_ROWS = 16384


@dataclass
class Cell:
    """A range of keys: of the first key, or of the second one under a single first key."""

    lo: int
    hi: int
    below: int
    first: int | None = None
    wanted: list[int] = field(default_factory=list)

    def holds(self, k1: Column, k2: Column) -> Column:
        if self.first is None:
            return k1.between(self.lo, self.hi)
        return (k1 == self.first) & k2.between(self.lo, self.hi)


def text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Least pairs (k1, k2) of shards 1 to ``shards`` - 1, ascending; keyed has k1, k2, size.

    A splitter's bytes below differ from its target by ``tolerance`` of a
    shard's share at most, or by half of the row that spans the target. A
    boundary between different texts is taken where tolerance allows; otherwise
    a group of equal texts is cut between ids.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    targets = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    chosen: dict[int, tuple[int, int]] = {}
    cells = [Cell(0, TOP, 0, None, list(range(len(targets))))]
    k1, k2 = F.col("k1"), F.col("k2")
    while cells:
        per = max(2, PROBES // len(cells))
        place = F.lit(None).cast("long")
        for n, cell in enumerate(cells):
            width = (cell.hi - cell.lo) // per + 1
            key = "k1" if cell.first is None else "k2"
            place = F.when(cell.holds(k1, k2), F.lit(n * per) + F.expr(f"({key} - {cell.lo}L) div {width}L")).otherwise(place)
        counted = keyed.select(place.alias("place"), "k1", "k2", "size").where("place is not null").groupBy("place")
        seen = counted.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("k1").alias("lo1"), F.max("k1").alias("hi1"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).collect()
        by_cell: dict[int, list] = {}
        for row in sorted(seen, key=lambda r: r["place"]):
            by_cell.setdefault(min(row["place"] // per, len(cells) - 1), []).append(row)
        finer: dict[tuple, Cell] = {}
        for n, cell in enumerate(cells):
            rows = by_cell.get(n, [])
            edges, at = [], cell.below
            for row in rows:
                edges.append(at)
                at += row["bytes"]
            for t in cell.wanted:
                i = max((i for i in range(len(rows)) if edges[i] <= targets[t]), default=0)
                row, under = rows[i], edges[i]
                over = under + row["bytes"]
                one_text = row["lo1"] == row["hi1"]
                deep = cell.first is not None
                start = (row["lo1"], row["lo2"] if deep else 0)
                after = (row["hi1"], row["hi2"] + 1) if deep else (row["hi1"] + 1, 0)
                single = row["n"] == 1 or (one_text and row["lo2"] == row["hi2"])
                if single or min(targets[t] - under, over - targets[t]) <= slack:
                    chosen[t] = start if targets[t] - under <= over - targets[t] else after
                elif one_text:
                    finer.setdefault((row["lo1"], row["lo2"]), Cell(row["lo2"], row["hi2"], under, row["lo1"])).wanted.append(t)
                else:
                    finer.setdefault((row["lo1"], None), Cell(row["lo1"], row["hi1"], under)).wanted.append(t)
        cells = list(finer.values())
    return [chosen[t] for t in range(len(targets))]


def _above(k1: Column, k2: Column, at: tuple[int, int]) -> Column:
    one, two = at
    if one > TOP:
        return F.lit(False)
    if two > TOP:
        return k1 > F.lit(one)
    return (k1 > F.lit(one)) | ((k1 == F.lit(one)) & (k2 >= F.lit(two)))


def histogram_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> DataFrame:
    """``df`` with size, shard and slot: shards 0 to ``shards`` - 1 of nearly equal bytes.

    size is the UTF-8 bytes of the text plus 16; a null text counts as empty.
    slot numbers the rows of a shard from 0 without gaps, in a random but
    repeatable order. A null id is a key like any other. Rows equal in text and
    id stay in one shard, in any order among themselves. Fewer rows than shards
    leave shards empty; an empty table stays empty. Input columns named like an
    output column are replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(16).cast("long")
    k1, k2 = text_key(text), F.shiftrightunsigned(F.xxhash64(id_col), 1)
    keyed = cut(df.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")))
    at = splitters(keyed, shards, tolerance)

    def shard(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x + y, [_above(a, b, s).cast("int") for s in at], F.lit(0))

    bits = max(0, (keyed.count() // (shards * BLOCK_ROWS)).bit_length())
    part = F.shiftright("__k2", 63 - bits) if bits else F.lit(0).cast("long")
    base = df.drop("size", "shard", "slot", "__k1", "__k2", "__part")
    out = base.withColumns({"size": size, "__k1": k1, "__k2": k2}).withColumn("shard", shard(F.col("__k1"), F.col("__k2"))).withColumn("__part", part)
    order = Window.partitionBy("shard", "__part").orderBy("__k2", "__k1")
    out = out.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    if bits:
        counts = keyed.select(shard(F.col("k1"), F.col("k2")).alias("shard"), F.shiftright("k2", 63 - bits).alias("__part")).groupBy("shard", "__part").count()
        before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
        out = out.join(starts, ["shard", "__part"]).withColumn("slot", F.col("slot") + F.col("__start")).drop("__start")
    else:
        drop(keyed)
    names = [c for c in base.columns]
    return out.select(*names, "size", "shard", "slot")
