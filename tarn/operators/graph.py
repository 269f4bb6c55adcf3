"""Graph operators over edge tables (src, dst): iterative joins whose state is checkpointed each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def merge_edges(links: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind): refs, lines, specs and symbols of its links; none to itself.

    ``links`` has source, target, kind, spec, line, name, local, count and side.  A symbol, (name, local),
    counts once however many links have it; a dynamic import, or one for its side effect, is one use at
    least, while any other import that uses nothing has none.
    """
    kept = links.filter("source <> target")
    symbol = F.collect_set(F.when(F.col("name") != "", F.struct("name", "local", "count")))
    edges = kept.groupBy("source", "target", "kind").agg(symbol.alias("s"), F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("spec")).alias("specs"), F.bool_or("side").alias("side"))
    own = F.filter("s", lambda x: ~F.exists("s", lambda y: (y["name"] == x["name"]) & (y["local"] == x["local"]) & (y["count"] > x["count"])))
    sums = edges.withColumn("s", own).withColumn("sum", F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["count"]))
    refs = F.when((F.col("kind") == "dynamic") | F.col("side"), F.greatest("sum", F.lit(1))).otherwise(F.col("sum"))
    return sums.select("source", "target", "kind", refs.alias("refs"), "lines", "specs", F.array_sort(F.array_distinct("s.name")).alias("symbols"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, instability): counts of edges, not of neighbours."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    joined = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return joined.withColumn("instability", F.when(total > 0, F.floor(F.col("fan_out") / total * 100 + 0.5) / 100).otherwise(0.0))


def role(is_test: Column, fan_in: Column, fan_out: Column, inner_out: Column, exports: Column, reexports: Column) -> Column:
    """A file's role, the first that holds."""
    return (
        F.when(is_test, "test")
        .when((fan_in == 0) & (inner_out == 0), "orphan")
        .when(fan_in == 0, "entry")
        .when((exports > 0) & (fan_out > 0) & (reexports == fan_out), "barrel")
        .when(fan_in >= 3, "hub")
        .when(fan_out == 0, "leaf")
        .otherwise("module")
    )


def reach(edges: DataFrame, seeds: DataFrame, *, hops: int | None = None, cap: int | None = None) -> DataFrame:
    """(seed, node, depth): what each of ``seeds`` (seed, node) reaches along the edges, at which least depth.

    A round joins the newest nodes with the edges and drops what is known; it ends with the first
    round that finds nothing, or after ``hops`` where just that neighbourhood is asked for.  A seed that
    has ``cap`` nodes isn't followed further; its last round is whole, so it has ``cap`` or more.
    """
    out = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    seen = cut(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    depth = 0
    while hops is None or depth < hops:
        depth += 1
        if cap is not None:
            full = seen.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > cap).select("seed")
            frontier = frontier.join(full, "seed", "left_anti")
        step = frontier.join(out, "node").select("seed", F.col("to").alias("node")).distinct()
        frontier = cut(step.join(seen.select("seed", "node").hint("merge"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def backwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(backwards(edges)).distinct()


def straight(edges: DataFrame, *, ids: int = 300) -> DataFrame:
    """(node, hops, ids): nodes from which one path alone leads on, up to one without edges: its length and its first ``ids`` nodes.

    Paths double each round, so a path of a thousand nodes takes ten.  Nodes before a fork or a cycle aren't among them.
    """
    out = cut(edges.filter("src <> dst or dst is null").groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("at"), F.bool_or(F.col("dst").isNull()).alias("lost")))
    one = (F.col("n") == 1) & ~F.col("lost")
    state = cut(out.filter(one).select("node", "at", F.lit(1).cast("long").alias("hops"), F.array("at").alias("ids"), F.lit(True).alias("live")))
    whole = state.count()
    firsts, long = None, 1
    # what is still on its way after more hops than there are such nodes goes round in a cycle
    while not state.filter(F.col("live") & (F.col("hops") <= whole)).isEmpty():
        if firsts is None and long >= ids:
            # all have their first ids by now, which need no further rounds
            firsts = state.select("node", F.slice("ids", 1, ids).alias("ids"))
            state = state.drop("ids")
        on = state.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("hops").alias("__hops"), *([F.col("ids").alias("__ids")] if firsts is None else []))
        met = state.filter("live").join(on, "at", "left")
        both = F.slice(F.concat("ids", F.coalesce("__ids", F.slice("ids", 1, 0))), 1, ids)
        moved = met.select("node", F.coalesce("__at", "at").alias("at"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), *([both.alias("ids")] if firsts is None else []), F.col("__at").isNotNull().alias("live"))
        state = cut(moved.union(state.filter("not live").select(moved.columns)))
        long *= 2
    ended = state.filter("not live").join(out.filter(~one).select(F.col("node").alias("at")), "at", "left_anti")
    return (ended if firsts is None else ended.join(firsts, "node")).select("node", "hops", "ids")


def impact(edges: DataFrame, nodes: DataFrame, *, cap: int | None = None, ids: int = 300) -> DataFrame:
    """(node, total, direct, depth, capped, levels, ids): who depends on each node, directly or not.

    With a ``cap``, a node that so many others depend on isn't followed further, and ``capped`` says so; else
    all are followed to their ends.  levels counts the dependents at each depth, and ids are the first by
    depth and name, as many as asked for.
    Where one chain is all that depends on a node, its length tells that; the others are followed step by step.
    """
    least = (lambda n: n) if cap is None else (lambda n: min(n, cap - 1))
    back = cut(backwards(edges).distinct())
    chains = cut(straight(back, ids=least(ids)).join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi"))
    total = F.col("hops") if cap is None else F.least(F.col("hops"), F.lit(cap - 1).cast("long"))
    beyond = F.lit(False) if cap is None else F.col("hops") >= cap
    told = chains.select("node", total.alias("total"), F.lit(least(1)).cast("long").alias("direct"), total.cast("int").alias("depth"), beyond.alias("capped"), F.array_repeat(F.lit(1).cast("long"), total.cast("int")).alias("levels"), "ids")
    rest = nodes.select(F.col("id").alias("node")).distinct().join(back.select(F.col("src").alias("node")), "node", "left_semi").join(chains.select("node"), "node", "left_anti")
    rest = cut(rest.select(F.col("node").alias("seed"), "node"))
    if rest.isEmpty():
        return told
    found = reach(back, rest, cap=cap).filter("depth > 0 and node <> seed")
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node")))
    # without a cap nothing but the first ids has to be put in order
    kept = found if cap is None else placed.filter(F.col("place") < cap)
    each = kept.groupBy("seed", "depth").agg(F.count("*").alias("n")).groupBy("seed").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("depth") == 1, F.col("n")).otherwise(0)).alias("direct"),
        F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("l"),
        F.max("depth").alias("depth"),
    )
    full = each.withColumn("capped", F.lit(False)) if cap is None else each.join(found.groupBy("seed").agg((F.count("*") >= cap).alias("capped")), "seed")
    first = placed.filter(F.col("place") <= least(ids)).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("i"))
    followed = full.join(first, "seed", "left").select(F.col("seed").alias("node"), "total", "direct", "depth", "capped", F.col("l.n").alias("levels"), F.coalesce(F.col("i.node"), F.slice(F.array("seed"), 1, 0)).alias("ids"))
    return told.union(followed)


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, node): a shortest path that ignores directions; of several the one whose later nodes are smallest."""
    both = undirected(edges)
    seeds = edges.sparkSession.createDataFrame([(start, start)], "seed string, node string")
    depth = reach(both, seeds).select("node", "depth")
    depth = cut(depth)
    last = depth.filter(F.col("node") == end).first()
    if last is None:
        return edges.sparkSession.createDataFrame([], "step int, node string")
    path, here = [(last["depth"], end)], end
    for d in range(last["depth"] - 1, -1, -1):
        here = both.filter(F.col("dst") == here).join(depth.filter(F.col("depth") == d), F.col("src") == F.col("node")).agg(F.min("src")).first()[0]
        path.append((d, here))
    return edges.sparkSession.createDataFrame(path, "step int, node string")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, depth) within ``hops`` steps either way."""
    return reach(undirected(edges), seeds, hops=hops)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches, ignoring directions."""
    both = cut(undirected(edges))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("now"))
        further = labels.select(F.col("node").alias("now"), F.col("component").alias("further"))
        moved = cut(step.join(further, "now", "left").select("node", "old", F.least("now", F.coalesce("further", "now")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels


def _trim(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both in and out, until none goes."""
    n = edges.count()
    while True:
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = cut(inner.select("src", "dst"))
        if (left := edges.count()) == n:
            return edges
        n = left


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their smallest node.

    Nodes that no cycle passes are trimmed.  Then each node takes the greatest node that reaches it as
    its colour; within a colour, what reaches the node of that name is its component.  Found components
    leave, and the rest is coloured again.
    """
    spark = edges.sparkSession
    live = _trim(cut(edges.select("src", "dst").filter("src <> dst").distinct()))
    kind = edges.schema["src"].dataType.simpleString()
    found = spark.createDataFrame([], f"node {kind}, root {kind}")
    while not live.isEmpty():
        colour = cut(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            came = live.join(colour, live.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
            moved = cut(colour.join(came, "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", "came").alias("colour")))
            colour = moved.select("node", "colour")
            if moved.filter("old <> colour").isEmpty():
                break
        own = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
        inside = cut(own.filter("c1 = c2").select("src", "dst"))
        roots = colour.filter("node = colour").select(F.col("node").alias("seed"), "node")
        done = cut(reach(backwards(inside), roots).select("node", F.col("seed").alias("root")))
        found = cut(found.union(done))
        left = live.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = _trim(cut(left.select("src", "dst")))
    sized = found.withColumn("n", F.count("*").over(Window.partitionBy("root"))).withColumn("component", F.min("node").over(Window.partitionBy("root")))
    return sized.filter("n > 1").select("node", "component")


def communities(edges: DataFrame, nodes: DataFrame | None = None, *, rounds: int = 30) -> DataFrame:
    """(node, community) by label propagation over weighted edges (src, dst, weight), directions ignored.

    Labels are those of a sequential run: nodes move by falling number of neighbours, then by name; each
    takes the label of most weight around it, its own if none has more, else the smallest of those, up to ``rounds`` times.
    That order is kept without a sequence: a node moves for the t-th time as soon as its neighbours before it in the
    order have moved t times and those behind it t - 1 times, so every step moves all nodes
    that wait for nobody, whichever round they are in.  Nobody's label changing through a whole round ends it.
    A label that one node alone has becomes that of its best neighbour.  ``nodes`` (id) without edges keep their own.
    """
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), "weight")).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = cut(both)
    degree = both.groupBy("src").agg(F.count("*").alias("n"))
    order = lambda x: degree.select(F.col("src").alias(x), F.struct((-F.col("n")).alias("n"), F.col("src")).alias(f"o_{x}"))
    # first: the neighbour dst moves before src
    around = cut(both.join(order("src"), "src").join(order("dst"), "dst").select("src", "dst", "weight", (F.col("o_dst") < F.col("o_src")).alias("first")))
    state = cut(degree.select(F.col("src").alias("node"), F.col("src").alias("community"), F.lit(0).alias("done"), F.lit(0).alias("moved")))
    def wave(state: DataFrame) -> DataFrame:
        at = lambda x, *more: state.select(F.col("node").alias(x), *more)
        seen = around.join(at("src", F.col("done").alias("mine"), F.col("community").alias("own")), "src").join(at("dst", F.col("done").alias("theirs"), F.col("community").alias("label")), "dst")
        # a node too far ahead of one that waits for it can't be: it waits for that one in turn
        ready = F.bool_and(F.when(F.col("first"), F.col("theirs") > F.col("mine")).otherwise(F.col("theirs") >= F.col("mine"))).alias("ready")
        weights = seen.groupBy("src", "label").agg(F.sum("weight").alias("weight"), F.first("own").alias("own"), F.first("mine").alias("mine"), ready)
        here = Window.partitionBy("src")
        top = weights.withColumns({"top": F.max("weight").over(here), "all": F.bool_and("ready").over(here)}).filter((F.col("all")) & (F.col("mine") < rounds) & (F.col("weight") >= F.col("top") - 1e-9))
        pick = top.groupBy("src").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("label"))).alias("stay"), F.min("label").alias("least"))
        chosen = pick.select(F.col("src").alias("node"), F.coalesce("stay", "least").alias("now"))
        done = F.when(F.col("now").isNotNull(), F.col("done") + 1).otherwise(F.col("done"))
        change = F.col("now").isNotNull() & (F.col("now") != F.col("community"))
        return state.join(chosen, "node", "left").select("node", F.coalesce("now", "community").alias("community"), done.alias("done"), F.when(change, F.col("done") + 1).otherwise(F.col("moved")).alias("moved"))

    turn = 0
    while True:
        # waves past the end change nothing, so two go into one table and not every one is followed by a look
        if turn % 4 == 0:
            ends = state.agg(F.min("done").alias("done"), F.max("moved").alias("moved")).first()
            if ends["done"] is None or ends["done"] >= rounds or ends["done"] > ends["moved"]:
                break
        state = cut(wave(wave(state)))
        turn += 1
    labels = state.select("node", "community")
    sized = cut(labels.withColumn("n", F.count("*").over(Window.partitionBy("community"))))
    lone = sized.filter("n = 1").select(F.col("node").alias("src")).join(both, "src").groupBy("src").agg(F.min_by("dst", F.struct(-F.col("weight"), F.col("dst"))).alias("best"))
    # one joins what its best neighbour has by then: a lone one with a smaller name has joined another already
    joins = cut(lone.join(sized.select(F.col("node").alias("best"), F.col("community").alias("label"), (F.col("n") == 1).alias("lone")), "best").select("src", "label", F.when(F.col("lone") & (F.col("best") < F.col("src")), F.col("best")).alias("next")))
    while not joins.filter("next is not null").isEmpty():
        further = joins.select(F.col("src").alias("next"), F.col("label").alias("l"), F.col("next").alias("n"))
        joins = cut(joins.join(further, "next", "left").select("src", F.coalesce("l", "label").alias("label"), F.col("n").alias("next")))
    found = labels.join(joins.select(F.col("src").alias("node"), "label"), "node", "left").select("node", F.coalesce("label", "community").alias("community"))
    if nodes is None:
        return found
    bare = nodes.select(F.col("id").alias("node")).join(found, "node", "left_anti")
    return found.unionByName(bare.select("node", F.col("node").alias("community")))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, cohesion, lead): the weight of edges (src, dst, weight) inside among those touching it,
    1 where none does, and its node of most edges."""
    a, b = (labels.select(F.col("node").alias(x), F.col("community").alias(f"{x}_c")) for x in ("src", "dst"))
    both = edges.select("src", "dst", "weight").join(a, "src").join(b, "dst")
    ends = both.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_c").alias("community")), F.struct(F.col("dst").alias("node"), F.col("dst_c").alias("community")))).alias("e"), "weight", (F.col("src_c") == F.col("dst_c")).alias("inside"))
    per = ends.groupBy("e.community", "e.node").agg(F.count("*").alias("degree"), F.sum("weight").alias("all"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("inside"))
    rolled = per.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("all").alias("all"), F.max_by("node", F.struct("degree", "node")).alias("lead"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    inside = F.col("inside") / 2
    return sizes.join(rolled, "community", "left").select("community", "size", F.coalesce(F.floor(inside / (F.col("all") - inside) * 100 + 0.5) / 100, F.lit(1.0)).alias("cohesion"), "lead")


def trace(reexports: DataFrame, uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, user, count, via): who uses each symbol (file, name), directly or through files that
    export it again (source, target, name: ``*`` for all).  A path never passes a file twice."""
    at = cut(symbols.select("file", "name", F.col("file").alias("here"), F.array().cast("array<string>").alias("via")))
    found = at
    while True:
        again = reexports.select(F.col("source").alias("next"), F.col("target").alias("here"), F.col("name").alias("exported"))
        at = cut(at.join(again, "here").filter((F.col("exported") == "*") | (F.col("exported") == F.col("name"))).filter(~F.array_contains("via", F.col("next")) & (F.col("next") != F.col("file"))).select("file", "name", F.col("next").alias("here"), F.concat("via", F.array("next")).alias("via")).distinct())
        if at.isEmpty():
            break
        found = found.union(at)
    used = uses.select(F.col("source").alias("user"), F.col("target").alias("here"), F.col("name").alias("used"), "count")
    met = found.join(used, (found.here == used.here) & ((found.name == used.used) | (used.used == "*")))
    return met.groupBy("file", "name", "user").agg(F.sum("count").alias("count"), F.min("via").alias("via"))
