"""Recursive operators: loops of joins over tables that shrink to what is new.

Each round is a plan of a few joins on hashed keys (HOPS steps along the edges) and one anti join; its outcome is written
to the shared folder, so that the lineage stays short and a lost executor costs one task. Every loop ends by itself (sets only grow) or at a stated limit.

Nodes with a single edge out make a function, and ways along it are doubled each round: components and the set and mask
fixpoints take the logarithm of its longest way, and loops go over what is left, the nodes with several edges out.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Rounds after which a growing union of tables is written as one, and steps along edges that a round takes in one plan.
UNION, HOPS = 8, 4


class LimitReached(RuntimeError):
    """A fixpoint needed more rounds than it was allowed."""


def _single(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """step (node, to): the end of a node's only edge, the node itself if it has none or several; many: the edges of nodes
    that have several. edges: each once, none from a node to itself."""
    out = written(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("end")))
    nodes = out.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    step = nodes.join(out.where("n = 1"), F.col("node") == F.col("src"), "left").select("node", F.coalesce("end", "node").alias("to"))
    return step, edges.join(out.where("n > 1"), "src", "left_semi")


def _levels(step: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """levels, circles of a function (node, to). Level j (node, to) goes 2^j steps, from the nodes that 2^j - 1 steps lead
    to from any node; the last one holds the nodes on circles alone. circles: node, component (its circle's smallest
    node).

    What nothing leads to falls away, so levels shrink and the work is near linear. When nothing falls away any more, steps
    are a permutation; the smallest node of the steps gone so far is the circle's as soon as it changes nowhere."""
    now = written(step.select("node", "to", F.col("node").alias("low")))
    levels, count, shrinks = [now], now.count(), True
    while True:
        here = now.join(now.select(F.col("to").alias("node")).distinct(), "node", "left_semi") if shrinks else now
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("other"))
        new = written(here.join(ahead, "to").select("node", F.col("further").alias("to"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved")))
        n, moved = new.agg(F.count("*"), F.bool_or("moved")).first()
        now, shrinks, count = new.drop("moved"), n < count, n
        if shrinks:
            levels.append(now)
        elif not moved:
            return [x.select("node", "to") for x in levels], now.select("node", F.col("low").alias("component"))


def _along(rows: DataFrame, levels: list[DataFrame], circles: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (node, value), and for each node those of all nodes that its steps lead to. merge: makes one of rows that
    say the same."""
    parts = [rows]
    for near, far in zip(levels, levels[1:]):
        last = parts[-1].withColumnRenamed("node", "to")
        nodes = far.select("node")
        parts.append(written(merge(parts[-1].join(nodes, "node", "left_semi").union(near.join(nodes, "node", "left_semi").join(last, "to").select("node", "value")))))
    round_ = merge(parts[-1].join(circles, "node").select(F.col("component").alias("node"), "value")).withColumnRenamed("node", "component")
    found = written(circles.join(round_, "component").select("node", "value"))
    for part, near, far in zip(parts[-2::-1], levels[-2::-1], levels[:0:-1]):
        nodes = far.select("node")
        ahead = near.join(nodes, "node", "left_anti").join(found.withColumnRenamed("node", "to"), "to").select("node", "value")
        found = found.union(written(merge(part.join(nodes, "node", "left_anti").union(ahead))))
    return found if len(levels) > 1 else found.union(rows.join(levels[0].select("node"), "node", "left_anti"))


def _onward(seeds: DataFrame, step: DataFrame) -> DataFrame:
    """node: the seeds and all that steps lead to from them."""
    known, now, before = written(seeds.select("node").distinct()), step, -1
    while before != (n := known.count()):
        before = n
        now = written(now)
        known = written(known.union(now.join(known, "node", "left_semi").select("to")).distinct())
        now = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
    return known


def _fixpoint(rows: DataFrame, steps: DataFrame, merge: Callable[[DataFrame], DataFrame], rounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """rows (node, value) handed up along steps (src has those of dst): along single edges by doubling, and between nodes
    with several edges by rounds, each of them offered what lies on the single edges behind its own."""
    step, many = _single(steps)
    levels, circles = _levels(step)
    found = _along(rows, levels, circles, merge)
    if many.isEmpty():
        return found
    # ways along single edges end in a circle or at a root
    roots = written(_along(levels[0].where("node = to").select("node", F.col("node").alias("value")), levels, circles, DataFrame.distinct)).select("node", F.col("value").alias("root"))
    own = rows.join(many.select(F.col("src").alias("node")), "node", "left_semi")
    offered = many.join(found, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "value")
    core = many.join(roots, F.col("dst") == F.col("node")).where("src <> root").select("src", F.col("root").alias("dst")).distinct()
    far = rounds(merge(own.union(offered)), written(core)).withColumnRenamed("node", "root")
    return merge(found.union(roots.join(far, "root").select("node", "value")))


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node: the seeds (column node) and all that edges (src, dst) lead to from them. Each node enters the frontier once,
    so the work is linear in the edges."""
    steps = written(edges.select("src", "dst").where("src <> dst").distinct())
    known = frontier = written(seeds.select("node").distinct())
    for step in range(1, max_rounds + 1):
        ahead, found = frontier, None
        for _ in range(HOPS):
            ahead = ahead.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            found = ahead if found is None else found.union(ahead)
        frontier = written(found.distinct().join(known, "node", "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.union(frontier) if step % UNION else written(known.union(frontier))
    raise LimitReached(f"reachable: {max_rounds} rounds")


def closure(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """src, dst: all pairs joined by a path of one edge or more. Paths double their length each round (a pair is joined
    with pairs), so a chain of n edges takes about log2(n) rounds. The output may be quadratic; where sources are known,
    reachable() is the operator to use."""
    known = delta = written(edges.select("src", "dst").distinct())
    for _ in range(max_rounds):
        left = delta.select(F.col("src").alias("a"), F.col("dst").alias("m"))
        right = known.select(F.col("src").alias("m"), F.col("dst").alias("b"))
        forward = left.join(right, "m").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        left2 = known.select(F.col("src").alias("a"), F.col("dst").alias("m"))
        right2 = delta.select(F.col("src").alias("m"), F.col("dst").alias("b"))
        both = forward.union(left2.join(right2, "m").select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
        delta = written(both.join(known, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            return known
        known = written(known.union(delta))
    raise LimitReached(f"closure: {max_rounds} rounds")


def scc(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node, component (its smallest node): the strongly connected components of edges (src, dst) that have a cycle; a
    node with an edge to itself is one.

    Circles of nodes with a single edge are components. Other nodes with a single edge are drawn into the root it leads to:
    they belong to its component if an edge from inside leads to them or to a node behind them. Roots are left to
    _coloured().
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    step, many = _single(written(edges.select("src", "dst").where("src <> dst").distinct()))
    levels, circles = _levels(step)
    found = circles.join(levels[0].where("node <> to"), "node", "left_semi")
    if not many.isEmpty():
        roots = written(_along(levels[0].where("node = to").select("node", F.col("node").alias("value")), levels, circles, DataFrame.distinct)).select("node", F.col("value").alias("root"))
        core = written(many.join(roots, F.col("dst") == F.col("node")).select("src", "dst", "root"))
        parts = _coloured(core.where("src <> root").select("src", F.col("root").alias("dst")).distinct(), max_rounds)
        parts = written(parts.union(core.where("src = root").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct().join(parts, "node", "left_anti")))
        part = lambda key: parts.select(F.col("node").alias(key), F.col("component").alias(f"{key}_part"))
        entries = core.join(part("src"), "src").join(part("root"), "root").where("src_part = root_part").select(F.col("dst").alias("node"))
        inside = _onward(entries, levels[0]).join(roots, "node").join(part("root"), "root").select("node", F.col("root_part").alias("part"))
        inside = written(inside.union(parts.select("node", "component")).distinct())
        least = inside.groupBy("part").agg(F.min("node").alias("component"))
        found = found.union(inside.join(least, "part").select("node", "component"))
    return found.union(loops.join(found, "node", "left_anti"))


def _coloured(edges: DataFrame, max_rounds: int) -> DataFrame:
    """node, component: the components of two nodes or more, of edges between different nodes.

    Rounds of trimming, colouring and walking back: nodes without edges in or out are cut off; each node takes the
    smallest node that reaches it as its colour; what reaches a colour's own node inside the colour is its component.
    """
    left = written(edges)
    found = edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    for _ in range(max_rounds):
        before = None
        while before != (now := left.count()):  # trim
            before = now
            for _ in range(HOPS):
                sources, targets = left.select(F.col("src").alias("n")).distinct(), left.select(F.col("dst").alias("n")).distinct()
                left = left.join(targets, F.col("src") == F.col("n"), "left_semi").join(sources, F.col("dst") == F.col("n"), "left_semi")
            left = written(left)
        if not now:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = written(nodes.withColumn("c", F.col("node")))
        while True:
            new = colour
            for _ in range(HOPS):
                offered = left.join(new, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("o"))
                new = new.join(offered, "node", "left").select("node", F.least("c", F.coalesce("o", "c")).alias("c"))
            # what reaches a node's colour reaches the node
            jump = new.select(F.col("node").alias("c"), F.col("c").alias("o"))
            new = new.join(jump, "c", "left").select("node", F.least("c", F.coalesce("o", "c")).alias("c"))
            new = written(new.join(colour.withColumnRenamed("c", "was"), "node"))
            colour = new.select("node", "c")
            if new.where("c <> was").isEmpty():
                break
        inside = left.join(colour.withColumnRenamed("c", "a"), F.col("src") == F.col("node")).drop("node").join(colour.withColumnRenamed("c", "b"), F.col("dst") == F.col("node")).where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = reachable(inside, colour.where("node = c").select("node")).join(colour, "node").select("node", F.col("c").alias("component"))
        sized = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        part = written(members.join(sized, "component", "left_semi").select("node", "component"))
        found = found.union(part)
        gone = members.select(F.col("node").alias("n"))
        left = written(left.join(gone, F.col("src") == F.col("n"), "left_anti").join(gone, F.col("dst") == F.col("n"), "left_anti"))
    else:
        raise LimitReached(f"scc: {max_rounds} rounds")
    return found


def alias_chase(aliases: DataFrame) -> DataFrame:
    """alias, target: chains of aliases (columns alias, target; one row per alias) followed to the name that is no alias
    itself. Chains that run in a circle claim nothing and are dropped. Pointers are doubled each round."""
    now = written(aliases.select("alias", "target"))
    total = now.count()
    for _ in range(max(total, 2).bit_length() + 1):
        nxt = now.select(F.col("alias").alias("target"), F.col("target").alias("further"))
        moved = written(now.join(nxt, "target", "left").select("alias", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        now = moved.select("alias", "target")
        if moved.where("moved").isEmpty():
            break
    return now.join(aliases.select(F.col("alias").alias("target")), "target", "left_anti").select("alias", "target")


def set_fixpoint(base: DataFrame, edges: DataFrame) -> DataFrame:
    """node, value: the pairs of base, and for each edge (src, dst) src has all values of dst."""
    steps = written(edges.select("src", "dst").where("src <> dst").distinct())
    return _fixpoint(written(base.select("node", "value").distinct()), steps, DataFrame.distinct, _set_rounds)


def _set_rounds(base: DataFrame, steps: DataFrame) -> DataFrame:
    """Pairs that are new feed the next round."""
    known = delta = written(base)
    step = 0
    while True:
        step += 1
        ahead, found = delta, None
        for _ in range(HOPS):
            ahead = ahead.join(steps, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "value").distinct()
            found = ahead if found is None else found.union(ahead)
        delta = written(found.distinct().join(known, ["node", "value"], "left_anti"))
        if delta.isEmpty():
            return known
        known = known.union(delta) if step % UNION else written(known.union(delta))


def mask_fixpoint(base: DataFrame, edges: DataFrame) -> DataFrame:
    """node, mask: the mask of base (0 where it has none) joined by bitwise or with those of all nodes that edges
    (src, dst) lead to; each node of base and edges once."""
    steps = written(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = base.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
    joined = lambda rows: rows.groupBy("node").agg(F.bit_or("value").alias("value"))
    rows = written(joined(base.where("mask <> 0").select("node", F.col("mask").cast("long").alias("value"))))
    return nodes.join(_fixpoint(rows, steps, joined, _mask_rounds), "node", "left").select("node", F.coalesce("value", F.lit(0)).cast("long").alias("mask"))


def _mask_rounds(base: DataFrame, steps: DataFrame) -> DataFrame:
    """Only nodes whose mask grew feed the next round, and masks of 64 bits grow at most 64 times."""
    known = delta = written(base)
    while True:
        ahead, offered = delta, None
        for _ in range(HOPS):
            ahead = ahead.join(steps, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.bit_or("value").alias("value"))
            offered = ahead if offered is None else offered.union(ahead)
        offered = offered.groupBy("node").agg(F.bit_or("value").alias("o"))
        both = written(known.join(offered, "node", "full").select("node", F.coalesce("value", F.lit(0)).bitwiseOR(F.coalesce("o", F.lit(0).cast("long"))).alias("value"), F.coalesce("value", F.lit(0)).alias("old")))
        known, delta = both.select("node", "value"), both.where("value <> old").select("node", "value")
        if delta.isEmpty():
            return known


def saturating_fixpoint(base: DataFrame, edges: DataFrame, most: int = 2, cut: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """node, lower, upper: the least solution of value = min(most, own + the sum over edges (src, dst) of dst's value).

    base has node, lower and upper; edges may repeat, and each counts; a possible edge (column certain is false) adds to
    upper alone, and of several possible edges of one call (column call) the largest counts. Nodes of cut hand nothing to
    their callers. Paths add up, so this is no closure: the callers of what changed are summed up anew in rounds until nothing
    changes, and values only rise up to most, so at most 2 * most * nodes rounds are needed."""
    steps = edges.select("src", "dst", *[c for c in ("certain", "call") if c in edges.columns])
    if "certain" not in steps.columns:
        steps = steps.withColumn("certain", F.lit(True))
    if "call" not in steps.columns:
        # written at once: a lost task that is run again may number its rows in another order
        steps = written(steps.withColumn("call", F.monotonically_increasing_id()))
    if cut is not None:
        steps = steps.join(cut.select(F.col("node").alias("dst")), "dst", "left_anti")
    steps = written(steps)
    nodes = base.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
    zero, top = F.lit(0), F.lit(most)
    own = written(nodes.join(base.groupBy("node").agg(F.sum("lower").alias("l"), F.sum("upper").alias("u")), "node", "left").select("node", F.least(F.coalesce("l", zero), top).cast("int").alias("ol"), F.least(F.coalesce("u", zero), top).cast("int").alias("ou")))
    now = own.select("node", F.col("ol").alias("lower"), F.col("ou").alias("upper"))
    changed = now.where("lower > 0 OR upper > 0").select("node")
    for _ in range(max_rounds):
        # callers of what has changed are summed up anew, from all their calls; the rest stay as they are
        callers = written(steps.join(changed, F.col("dst") == F.col("node"), "left_semi").select("src").distinct())
        if callers.isEmpty():
            return now
        mine = steps.join(callers, "src", "left_semi").join(now, F.col("dst") == F.col("node"))
        each = mine.groupBy("src", "call").agg(F.max(F.when(F.col("certain"), F.col("lower"))).alias("l"), F.max("upper").alias("u"))
        added = each.groupBy(F.col("src").alias("node")).agg(F.sum("l").alias("l"), F.sum("u").alias("u"))
        new = now.withColumnsRenamed({"lower": "bl", "upper": "bu"}).join(own.join(added, "node"), "node", "left")
        total = lambda own_, sums, before: F.when(F.col("u").isNull(), F.col(before)).otherwise(F.least(F.col(own_) + F.coalesce(sums, zero), top)).cast("int")
        new = written(new.select("node", total("ol", "l", "bl").alias("lower"), total("ou", "u", "bu").alias("upper"), "bl", "bu"))
        now = new.select("node", "lower", "upper")
        changed = new.where("lower <> bl OR upper <> bu").select("node")
    raise LimitReached(f"saturating_fixpoint: {max_rounds} rounds")


def impact(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """node: the changed ones and all that depend on them, directly or not, by the old or the new edges (src depends on
    dst)."""
    edges = before.select("src", "dst").union(after.select("src", "dst"))
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed)


def cycle_witness(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, path: for each component a shortest cycle through its smallest node, as an array that begins and ends
    there; of several the first in order. Components that are mere circles are put in order by doubled ways back to the
    smallest node, all others are searched breadth-first at once."""
    inner = edges.select("src", "dst").distinct().join(components.select(F.col("node").alias("src"), "component"), "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2").select("component", "src", "dst")
    inner = written(inner)
    several = inner.groupBy("component", "src").agg(F.count("*").alias("n")).where("n > 1").select("component").distinct()
    several = written(several)
    circles = _circle_paths(inner.join(several, "component", "left_anti"))
    if several.isEmpty():
        return circles
    inner = inner.join(several, "component", "left_semi")
    start = written(several.select("component", F.col("component").alias("node"), F.array("component").alias("path")))
    done, seen, now = None, start.select("component", "node"), start

    def further(paths: DataFrame) -> DataFrame:
        to = paths.join(inner, (paths["component"] == inner["component"]) & (paths["node"] == inner["src"])).select(paths["component"], F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        return to.groupBy("component", "node").agg(F.min("path").alias("path"))

    step = 0
    while not now.isEmpty():
        step += 1
        ahead, steps = now, None
        for hop in range(HOPS):
            ahead = further(ahead.where("node <> component") if hop else ahead)
            own = ahead.withColumn("hop", F.lit(hop))
            steps = own if steps is None else steps.union(own)
        steps = written(steps)
        ended = steps.where("node = component").groupBy("component").agg(F.min_by("path", "hop").alias("path"))
        open_ = steps.where(f"hop = {HOPS - 1} AND node <> component").join(ended, "component", "left_anti").drop("hop")
        seen = seen.union(steps.where(f"hop < {HOPS - 1}").select("component", "node"))
        now = open_.join(seen, ["component", "node"], "left_anti")
        done, seen = ended if done is None else done.union(ended), seen.union(open_.select("component", "node"))
        if step % UNION == 0:
            done, seen, now = written(done), written(seen), written(now)
    return circles.union(done)


def _circle_paths(inner: DataFrame) -> DataFrame:
    """component, path of circles given by their edges (component, src, dst)."""
    first = F.col("dst") == F.col("component")
    now = written(inner.select("component", F.col("dst").alias("node"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("place")))
    while not (open_ := now.where("to <> component")).isEmpty():
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("place").alias("more"))
        moved = open_.join(ahead, "to").select("component", "node", F.col("further").alias("to"), (F.col("place") + F.col("more")).alias("place"))
        now = written(moved.union(now.where("to = component")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "node")))["node"]
    return now.groupBy("component").agg(F.concat(ordered, F.array(F.first("component"))).alias("path"))
