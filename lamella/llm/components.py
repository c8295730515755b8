"""Links between near duplicates found without listing all pairs of a group, and their components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.session import bounded, cut, drop, release

#: Standard deviations beyond its mean at the threshold that a sketch distance may have.
SIGMAS = 5.0


def hooking(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct links in an order of nodes by hash, and the hooks (node, root) of each round.

    Each round hooks every node to its smallest neighbour if that is smaller,
    and moves both ends of each link to where they were hooked; ends that meet
    are done. The order is by a hash of the node, so whatever order the nodes'
    names have, the smallest of each neighbourhood are a constant share of it,
    and the expected number of rounds is logarithmic: about 10 for a chain of
    1000 links, 2 for a star.
    """
    ordered = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    both = links.where("a <> b").select(ordered("a").alias("x"), ordered("b").alias("y"))
    first = edges = cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), few=True)
    hooks = []
    while not edges.isEmpty():
        hook = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), few=True)
        left, right = (hook.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        shorter = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), few=True)
        if hooks:
            drop(edges)
        hooks.append(hook)
        edges = shorter
    drop(edges)
    return first, hooks


def components(links: DataFrame) -> DataFrame | None:
    """Distributed union-find over ``links`` (a, b); (node, root), root being the smallest node reachable.

    The hooks of the rounds are put together from the last round, which has the
    fewest, to the first, and all nodes follow them in one join. Nothing reaches
    the driver but whether links are left. None without any link.
    """
    first, hooks = hooking(links)
    if not hooks:
        return None
    whole = hooks[-1]
    for hook in hooks[-2::-1]:
        up = whole.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        longer = cut(moved.unionByName(whole.join(hook.select("node"), "node", "left_anti")), few=True)
        drop(whole)
        whole = longer
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = cut(nodes.join(whole, "node", "left").select(F.col("node.id").alias("node"), F.coalesce("root", "node").alias("root")), few=True)
    # Written before it is joined, so that the members of a large component needn't meet in one task.
    least = cut(out.groupBy("root").agg(F.min("node").alias("least")), few=True)
    named = cut(out.join(bounded(least), "root").select("node", F.col("least").alias("root")), few=True)
    drop(first, whole, out, least, *hooks)
    return named


def united(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components ``roots`` (node, root) with ``links`` (a, b) added; only the links between components are followed."""
    if roots is None:
        return components(links)
    left, right = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    more = components(links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    if more is None:
        return roots
    up = more.select(F.col("node").alias("root"), F.col("root").alias("up"))
    moved = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(moved.unionByName(more.join(roots.select("node"), "node", "left_anti")), few=True)


def furthest(total: Column, percent: int, words: int) -> Column:
    """Sketch bits in which two sets of this similarity differ at most; ``total`` is the sum of their sizes.

    A sketch holds the parity of how many items fall on each of its m bits, so
    two sketches differ where an odd number of those items fall that are in one
    set only, d of them. At the threshold d is total * (1 - s) / (1 + s); the
    number of such bits has the mean m / 2 * (1 - exp(-2d/m)) and the variance
    m / 4 * (1 - exp(-4d/m)) - d * exp(-4d/m), and it never exceeds d. The limit
    lies five standard deviations and one bit above, which loses a link at the
    very threshold with a chance below 1e-6, and others still more rarely.
    """
    m = 64.0 * words
    d = total * ((100.0 - percent) / (100.0 + percent))
    e = F.exp(d * (-2.0 / m))
    spread = F.greatest(F.lit(m / 4) * (1.0 - e * e) - d * e * e, F.lit(0.0))
    return F.lit(m / 2) * (1.0 - e) + SIGMAS * F.sqrt(spread) + 1.0


def meeting(dealt: DataFrame, who: str = "node") -> DataFrame:
    """Distinct rows of ``dealt`` (key, ``who``, ...) whose key was dealt two different ``who`` at least.

    Most keys were dealt a single one, so all rows are shuffled as a key with
    the least and greatest of them, and a second time only if the keys left are
    many.
    """
    held = dealt.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi"))
    keys = cut(held.where("lo < hi").select("key"))
    out = cut(dealt.join(bounded(keys), "key", "left_semi").distinct())
    drop(keys)
    release(dealt.sparkSession)
    return out


def crowded(members: DataFrame) -> DataFrame:
    """Rows of buckets (key) that hold two labels at least, with main, the commonest label, n, the number of rows, and off, that of rows with other labels."""
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    held = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    keys = cut(held.where("n > top.n").select("key", F.col("top.label").alias("main"), "n", (F.col("n") - F.col("top.n")).alias("off")))
    out = cut(members.join(keys, "key"))
    drop(keys)
    return out


def buckets(met: DataFrame, abouts: DataFrame) -> DataFrame:
    """Members of buckets for ``resolve`` from ``met`` (key, node, at), in which all nodes of a bucket differ, and ``abouts`` (node, about)."""
    keys = cut(met.groupBy("key").agg(F.min("node").alias("lo"), F.count("*").alias("n")))
    rows = met.join(keys, "key").join(abouts, "node")
    out = cut(rows.select("key", "node", F.col("node").alias("label"), F.col("about").withField("at", F.col("at")).alias("about"), "lo", "n"))
    drop(keys)
    return out


def resolve(work: DataFrame, percent: int, verify: Callable[[DataFrame], DataFrame], words: int = 0, meet: Callable[[Column, Column], Column] | None = None, small: int = 8, tries: int = 32, pivots: int = 4096) -> DataFrame | None:
    """Components of the graph that links nodes of a common bucket which ``verify`` accepts.

    ``work`` is made by ``buckets``: key, node, label (the node itself), about, a
    struct of size, ``words`` sketch words s0, s1, ... and whatever ``meet``
    needs, lo and n. It says which buckets a node is in; ``verify`` keeps the
    pairs (a, b) that are links. A pair whose sizes or sketches rule a
    similarity of ``percent`` / 100 out is no candidate, and of several buckets
    that two nodes share only that in which ``meet`` of their abouts holds makes
    them one.

    Every other two nodes of a bucket are either verified or already connected
    through verified links, so no link between components is lost. The members
    of a small bucket are compared at once. No larger bucket's pairs are listed:
    its smallest node is compared with all others, then about ``tries`` of its
    members are, which draws groups of near copies into one component. Those
    that still are in other components than most of the bucket are pivots at
    last, ``pivots`` a turn at most, and are compared with the members of yet
    other components. Returns (node, root), or None without any link.
    """
    near = 100 * F.least("about.size", "pabout.size") >= percent * F.greatest("about.size", "pabout.size")
    if words:
        differ = [F.bit_count(F.col(f"about.s{i}").bitwiseXOR(F.col(f"pabout.s{i}"))) for i in range(words)]
        near = near & (sum(differ[1:], differ[0]) <= furthest(F.col("about.size") + F.col("pabout.size"), percent, words))
    if meet is not None:
        near = near & meet(F.col("about"), F.col("pabout"))
    mine = [F.col("key"), F.col("node"), F.col("label"), F.col("about")]
    other = [F.col("key"), F.col("node").alias("pnode"), F.col("label").alias("plabel"), F.col("about").alias("pabout")]

    def linked(pairs: DataFrame) -> DataFrame:
        """Few beside the rows that they come from, and written before they are joined with what verifies them."""
        found = cut(pairs.select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")).distinct(), few=True)
        out = cut(verify(found), few=True)
        drop(found)
        return out

    if work.isEmpty():
        return None
    few, many = work.where(F.col("n") <= small), work.where(F.col("n") > small)
    pairs = few.select(mine).join(few.select(other), "key").where((F.col("label") < F.col("plabel")) & near)
    heads = many.where("node = lo").select(other).dropDuplicates(["key"])
    roots = components(linked(pairs.unionByName(many.where("node <> lo").select(mine).join(heads, "key").where(near))))
    rest, turn = many.where("node <> lo").select(mine), 0
    while True:
        if roots is not None:
            named = roots.select("node", F.col("root").alias("named"))
            rest = rest.join(named, "node", "left").withColumn("label", F.coalesce("named", "label")).select(mine)
        work = crowded(rest)
        if work.isEmpty():
            return roots
        drawn = lambda all_, many: F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col(all_) / many)) == 0  # noqa: B023, E731
        # In the first turn some of all members; then all that aren't with most, unless they are so many that they take several turns.
        picked = drawn("n", tries) if turn == 0 else (F.col("label") != F.col("main")) & drawn("off", pivots)
        both = work.select(*mine, picked.alias("picked"))
        pairs = both.join(work.where(picked).select(other), "key").where((F.col("label") != F.col("plabel")) & (~F.col("picked") | (F.col("node") < F.col("pnode"))) & near)
        new = linked(pairs)
        if not new.isEmpty():
            roots = united(roots, new)
        if turn > 0 and work.where(F.col("off") > pivots).isEmpty():
            return roots
        rest, turn = both.where("not picked").select(mine), turn + 1
