"""Gains of moving nodes and joining communities under several qualities, and optimisers made of them.

Methods: modularity, configuration (modularity without its scale), cpm, significance
and surprise (the asymptotic form: weight times the divergence of its share inside
communities from the share of pairs there); sta, pos, smp, gja and neg weigh the
positive and the negative part of signed graphs.  Directed graphs hold their arcs,
undirected ones both directions.  Partitions may carry ``size``, how many nodes of the
first graph a node stands for; otherwise it is 1.

Inside, edges and partitions carry a key ``run``: many partitions, of one graph or of
several, at one resolution or at many, are optimised by the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

from .partitions import binary_kl, partition_at_level

SIGNED = ("sta", "pos", "smp", "gja", "neg")
METHODS = ("modularity", "configuration", "cpm", "significance", "surprise", *SIGNED)
#: A move counts as a rise of the quality above this (rounding of sums).
LEAST_GAIN = 1e-10
#: Sums of a community: nodes, weight inside, from and into it; p: positive, q: negative.
SUMS = ("n", "ip", "op", "np", "iq", "oq", "nq")


def _split(edges: DataFrame) -> DataFrame:
    """run, src, dst, p, q: positive and negative weight."""
    run = F.col("run") if "run" in edges.columns else F.lit(0)
    return edges.select(run.cast("bigint").alias("run"), "src", "dst", F.greatest(F.col("w"), F.lit(0.0)).alias("p"), F.greatest(-F.col("w"), F.lit(0.0)).alias("q"))


def _sized(parts: DataFrame) -> DataFrame:
    size = F.col("size") if "size" in parts.columns else F.lit(1)
    run = F.col("run") if "run" in parts.columns else F.lit(0)
    gamma = [F.col("gamma")] if "gamma" in parts.columns else []
    return parts.select(run.cast("bigint").alias("run"), "node", "comm", size.cast("double").alias("size"), *gamma)


def _ends(e: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with the communities of their ends, c1 and c2, within each run."""
    p = lambda end, comm: parts.select("run", F.col("node").alias(end), F.col("comm").alias(comm))
    return e.join(p("src", "c1"), ["run", "src"]).join(p("dst", "c2"), ["run", "dst"])


def _sums(e: DataFrame, parts: DataFrame, gamma: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """links (run, node, comm, lp, lq), nodes with the links to their own community, communities, totals of each run.

    The resolution stands with the totals: ``gamma``, or the column of that name in ``parts``.
    """
    own_gamma = F.max("gamma") if "gamma" in parts.columns else F.lit(float(gamma))
    both = _ends(e.where("src <> dst"), parts)
    side = lambda node, comm: F.struct(F.col(node).alias("node"), F.col(comm).alias("comm"), "p", "q")
    links = both.select("run", F.explode(F.array(side("src", "c2"), side("dst", "c1"))).alias("x")).groupBy("run", "x.node", "x.comm").agg(F.sum("x.p").alias("lp"), F.sum("x.q").alias("lq"))
    zero, loop = F.lit(0.0), F.col("src") == F.col("dst")
    own = lambda c: F.when(loop, F.col(c)).otherwise(zero)
    out = F.struct(F.col("src").alias("node"), F.col("p").alias("op"), F.col("q").alias("oq"), zero.alias("np"), zero.alias("nq"), own("p").alias("xp"), own("q").alias("xq"))
    into = F.struct(F.col("dst").alias("node"), zero.alias("op"), zero.alias("oq"), F.col("p").alias("np"), F.col("q").alias("nq"), zero.alias("xp"), zero.alias("xq"))
    names = ("op", "oq", "np", "nq", "xp", "xq")
    ends = e.select("run", F.explode(F.array(out, into)).alias("x")).groupBy("run", "x.node").agg(*[F.sum(f"x.{c}").alias(c) for c in names])
    nodes = parts.join(ends, ["run", "node"], "left").join(links, ["run", "node", "comm"], "left")
    nodes = nodes.select("run", "node", "comm", "size", *[F.coalesce(c, zero).alias(c) for c in (*names, "lp", "lq")])
    comms = nodes.groupBy("run", "comm").agg(
        F.sum("size").alias("n"), (F.sum("lp") / 2 + F.sum("xp")).alias("ip"), (F.sum("lq") / 2 + F.sum("xq")).alias("iq"), *[F.sum(c).alias(c) for c in ("op", "np", "oq", "nq")]
    )
    pairs = F.col("n") * (F.col("n") - 1)
    total = comms.groupBy("run").agg(F.sum("op").alias("tp"), F.sum("oq").alias("tq"), F.sum("n").alias("tn"), F.sum("ip").alias("ti"), F.sum(pairs).alias("tk"))
    total = total.join(parts.groupBy("run").agg(own_gamma.alias("gamma")), "run")  # a row for each run
    return links, nodes, comms, total


def _value(method: str, c: dict[str, Column]) -> Column:
    """What a community with the sums ``c`` adds to the quality, at the resolution of its run."""
    gamma = F.col("gamma")
    tp, tq, tn = F.col("tp"), F.col("tq"), F.col("tn")
    if method == "cpm":
        return c["ip"] - gamma * c["n"] * c["n"]
    if method == "significance":
        pairs = c["n"] * (c["n"] - 1)
        return F.when(c["n"] > 1, pairs * binary_kl(F.try_divide(c["ip"], pairs), tp / (tn * (tn - 1)))).otherwise(0.0)
    none = F.lit(0.0)
    x0 = c["ip"] - gamma * F.coalesce(F.try_divide(c["op"] * c["np"], tp), none)
    if method == "configuration":
        return x0
    if method == "modularity":
        return F.coalesce(F.try_divide(x0, tp), none)
    x1 = c["iq"] - gamma * F.coalesce(F.try_divide(c["oq"] * c["nq"], tq), none)
    d0 = {"sta": tp, "pos": tp, "smp": tp, "gja": tp + tq, "neg": None}[method]
    d1 = {"sta": tp + tq, "pos": None, "smp": tq, "gja": tp + tq, "neg": tq}[method]
    share = lambda x, d: none if d is None else F.coalesce(F.try_divide(x, d), none)
    return share(x0, d0) - share(x1, d1)


def _surprise(inside: Column, pairs: Column) -> Column:
    return F.col("tp") * binary_kl(inside / F.col("tp"), pairs / (F.col("tn") * (F.col("tn") - 1)))


def _qualities(e: DataFrame, parts: DataFrame, method: str, gamma: float) -> DataFrame:
    """run, quality."""
    *_, comms, total = _sums(e, parts, gamma)
    if method == "surprise":
        return total.select("run", _surprise(F.col("ti"), F.col("tk")).alias("quality"))
    return comms.join(total, "run").groupBy("run").agg(F.sum(_value(method, {c: F.col(c) for c in SUMS})).alias("quality"))


def _gains(e: DataFrame, parts: DataFrame, method: str, gamma: float) -> DataFrame:
    """run, node, now, comm, gain."""
    links, nodes, comms, total = _sums(e, parts, gamma)
    named = lambda key, k: comms.select("run", F.col("comm").alias(key), *[F.col(c).alias(f"{k}_{c}") for c in SUMS])
    at = nodes.withColumnsRenamed({"comm": "now", "lp": "kp", "lq": "kq"})
    rows = links.withColumnRenamed("comm", "to").join(at, ["run", "node"]).where("to <> now").join(named("now", "a"), ["run", "now"]).join(named("to", "b"), ["run", "to"]).join(total, "run")
    a, b = ({c: F.col(f"{k}_{c}") for c in SUMS} for k in "ab")
    # what the node takes out of its own community, and what it brings into the other
    takes = {"n": F.col("size"), "ip": F.col("kp") + F.col("xp"), "iq": F.col("kq") + F.col("xq")} | {c: F.col(c) for c in ("op", "np", "oq", "nq")}
    brings = takes | {"ip": F.col("lp") + F.col("xp"), "iq": F.col("lq") + F.col("xq")}
    left, joined = {c: a[c] - takes[c] for c in SUMS}, {c: b[c] + brings[c] for c in SUMS}
    if method == "surprise":
        pairs = lambda c: c["n"] * (c["n"] - 1)
        now = _surprise(F.col("ti"), F.col("tk"))
        gain = _surprise(F.col("ti") - F.col("kp") + F.col("lp"), F.col("tk") + pairs(left) + pairs(joined) - pairs(a) - pairs(b)) - now
    else:
        f = lambda c: _value(method, c)
        gain = f(left) + f(joined) - f(a) - f(b)
    return rows.select("run", "node", "now", F.col("to").alias("comm"), gain.alias("gain"))


def quality(edges: DataFrame, parts: DataFrame, method: str = "modularity", gamma: float = 1.0) -> DataFrame:
    """quality: one row."""
    return _qualities(_split(edges), _sized(parts), method, gamma).select("quality")


def move_gains(edges: DataFrame, parts: DataFrame, method: str = "modularity", gamma: float = 1.0) -> DataFrame:
    """node, comm, gain: how the quality changes if the node alone moves to a community that it has edges with."""
    return _gains(_split(edges), _sized(parts), method, gamma).select("node", "comm", "gain")


def _apart(moves: DataFrame, seed: int) -> DataFrame:
    """Of moves (run, a, b, gain, ...) those that no other move of a or b outdoes: no two of a run share a community."""
    order = F.struct("gain", F.xxhash64("run", "key", F.lit(seed)).alias("h"), "key")
    ends = moves.select("run", F.explode(F.array("a", "b")).alias("end"), order.alias("x"))
    first = ends.groupBy("run", "end").agg(F.max("x.gain").alias("gain"), F.max("x").alias("x")).select("run", "end", F.col("x.key").alias("key"))
    both = first.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return moves.join(both, ["run", "key"])


def _wandering(moves: DataFrame, seed: int) -> DataFrame:
    """In each run the half of the moves that a hash of the run picks, or all where it picks none."""
    mine = F.pmod(F.xxhash64("run", "key", F.lit(seed)), F.lit(2)) == 0
    some = moves.groupBy("run").agg(F.bool_or(mine).alias("some"))
    return moves.join(some, "run").where(mine | ~F.col("some")).drop("some")


def _step(e: DataFrame, now: DataFrame, moves: DataFrame, of: str, method: str, gamma: float, seed: int, wander: bool = False) -> DataFrame | None:
    """``now`` after those of the moves (run, key, a, b, gain: key goes from community a to b) that can be made at once; None without any.

    Gains of moves that share no community add up, for all qualities but surprise.  There the
    whole is taken again, and runs that did not rise make their best move alone.
    """
    moves = stored(moves, "moves")
    if not moves.limit(1).count():
        return None
    key = "node" if of == "node" else "comm"

    def moved(some: DataFrame) -> DataFrame:
        to = some.select("run", F.col("key").alias(key), F.col("b").alias("to"))
        return stored(now.join(to, ["run", key], "left").select("run", "node", F.coalesce("to", "comm").alias("comm"), *[c for c in now.columns if c not in ("run", "node", "comm")]), "moved")

    some = _apart(_wandering(moves, seed) if wander else moves, seed)
    if method != "surprise":
        return moved(some)
    new = moved(some)
    before, after = _qualities(e, now, method, gamma), _qualities(e, new, method, gamma).withColumnRenamed("quality", "new")
    rose = stored(before.join(after, "run").select("run", (F.col("new") > F.col("quality") + LEAST_GAIN).alias("rose")), "rose")
    single = moves.groupBy("run").agg(F.max_by("key", F.struct("gain", "key")).alias("key"))
    one = moves.join(single, ["run", "key"]).join(rose.where("NOT rose"), "run").select("run", "key", "a", "b", "gain")
    if not one.limit(1).count():
        return new
    return moved(some.join(rose.where("rose"), "run").select("run", "key", "a", "b", "gain").unionByName(one))


def _settle(e: DataFrame, parts: DataFrame, method: str, gamma: float, seed: int, wander: bool = False) -> DataFrame:
    """Move single nodes until no move raises the quality of its run; ``wander``: each run on a way of its own."""
    now = parts
    while True:
        seed += 1
        best = _gains(e, now, method, gamma).where(F.col("gain") > LEAST_GAIN).groupBy("run", "node", "now").agg(F.max(F.struct("gain", (-F.col("comm")).alias("c"))).alias("b"))
        step = _step(e, now, best.select("run", F.col("node").alias("key"), F.col("now").alias("a"), (-F.col("b.c")).alias("b"), F.col("b.gain").alias("gain")), "node", method, gamma, seed, wander)
        if step is None:
            return now
        now = step


def _collapsed(e: DataFrame, parts: DataFrame) -> DataFrame:
    """Communities as nodes; the positive and the negative weights are summed apart."""
    return _ends(e, parts).groupBy("run", F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def optimise_runs(edges: DataFrame, nodes: DataFrame, method: str = "modularity", gamma: float = 1.0, seed: int = 1, wander: bool = False) -> DataFrame:
    """run, level, node, comm: ``optimise`` for every run in ``nodes`` (run, node and, if wanted, gamma), all by the same jobs.

    edges: run, src, dst, w.  wander: runs of one graph take ways of their own.  A run whose last level changed nothing repeats it while others go on.
    """
    e = stored(_split(edges), "split")
    level, out = 0, None
    columns = ["gamma"] if "gamma" in nodes.columns else []
    parts = stored(nodes.select(F.col("run").cast("bigint").alias("run"), "node", F.col("node").alias("comm"), F.lit(1.0).alias("size"), *columns).distinct(), "level")
    while True:
        best = _settle(e, parts, method, gamma, seed + 1000 * level, wander)
        least = best.groupBy("run", "comm").agg(F.min("node").alias("least"))
        best = stored(best.join(least, ["run", "comm"]).select("run", "node", F.col("least").alias("comm"), "size", *columns), "level")
        if level and not best.where("node <> comm").limit(1).count():  # nothing was joined
            return out
        step = best.select("run", F.lit(level).alias("level"), "node", "comm")
        out = step if out is None else out.unionByName(step)
        e = stored(_collapsed(e, best), "split")
        parts = stored(best.groupBy("run", F.col("comm").alias("node"), F.col("comm").alias("comm"), *columns).agg(F.sum("size").alias("size")).select("run", "node", "comm", "size", *columns), "level")
        level += 1


def best_of_runs(edges: DataFrame, nodes: DataFrame, method: str = "modularity", gamma: float = 1.0, seed: int = 1, wander: bool = False) -> DataFrame:
    """run, node, comm: the last partitions of ``optimise_runs``."""
    tree = stored(optimise_runs(edges, nodes, method, gamma, seed, wander), "tree")
    out = tree.where("level = 0").select("run", "node", "comm")
    for i in range(1, tree.agg(F.max("level")).first()[0] + 1):
        step = tree.where(F.col("level") == i).select("run", F.col("node").alias("comm"), F.col("comm").alias("next"))
        out = out.join(step, ["run", "comm"]).select("run", "node", F.col("next").alias("comm"))
    return out


def optimise(edges: DataFrame, nodes: DataFrame, method: str = "modularity", gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """level, node, comm: partitions of rising quality, the communities of a level being the nodes of the next.

    Level 0 starts from single nodes; it ends when no move of a node raises the quality,
    the last level when no move of a community does.  In a step, all moves that no other
    move of the same communities outdoes are made.  A community is named by its least
    node.  Directed graphs hold their arcs, undirected ones both directions; signed
    methods take signed weights.  A graph without edges gives single nodes.
    """
    return optimise_runs(edges.select(F.lit(0).alias("run"), "src", "dst", "w"), nodes.select(F.lit(0).alias("run"), "node"), method, gamma, seed).drop("run")


def best_of(edges: DataFrame, nodes: DataFrame, method: str = "modularity", gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """node, comm: the last partition of ``optimise``."""
    tree = stored(optimise(edges, nodes, method, gamma, seed), "tree")
    return partition_at_level(tree, tree.agg(F.max("level")).first()[0])


def _shaken(e: DataFrame, parts: DataFrame, method: str, gamma: float, jump: Column, seed: int) -> DataFrame:
    """Nodes go with the chance ``jump`` to some community that they have edges with, whatever the gain."""
    some = _gains(e, parts, method, gamma).where(F.pmod(F.xxhash64("run", "node", F.lit(seed)), F.lit(1 << 30)) < jump * (1 << 30))
    some = some.groupBy("run", "node").agg(F.min_by("comm", F.xxhash64("run", "comm", "node", F.lit(seed))).alias("to"))
    return stored(parts.join(some, ["run", "node"], "left").select("run", "node", F.coalesce("to", "comm").alias("comm"), "size"), "shaken")


def finetune(edges: DataFrame, parts: DataFrame, method: str = "modularity", gamma: float = 1.0, jump: float = 0.0, seed: int = 1) -> DataFrame:
    """node, comm: ``parts`` after moves of single nodes, until no move raises the quality.

    ``jump`` is the chance of each node to go first to some community that it has edges
    with, whatever the gain; what comes of that counts only if it is better in the end.
    """
    e = stored(_split(edges), "split")
    parts = stored(_sized(parts), "start")
    best = _settle(e, parts, method, gamma, seed)
    if jump > 0:
        other = _settle(e, _shaken(e, parts, method, gamma, F.lit(jump), seed), method, gamma, seed)
        q = [_qualities(e, p, method, gamma).first()["quality"] or 0.0 for p in (best, other)]
        best = other if q[1] > q[0] else best
    return best.select("node", "comm")


def merge_gains(edges: DataFrame, parts: DataFrame, method: str = "surprise", gamma: float = 1.0) -> DataFrame:
    """a, b (a < b), gain: how the quality changes if two communities with edges between them become one."""
    return _merges(_split(edges), _sized(parts), method, gamma).select("a", "b", "gain")


def _merges(e: DataFrame, parts: DataFrame, method: str, gamma: float) -> DataFrame:
    _, _, comms, total = _sums(e, parts, gamma)
    between = _collapsed(e, parts).where("src <> dst").groupBy("run", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("p").alias("lp"), F.sum("q").alias("lq"))
    named = lambda k: comms.select("run", F.col("comm").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in SUMS])
    rows = between.join(named("a"), ["run", "a"]).join(named("b"), ["run", "b"]).join(total, "run")
    a, b = ({c: F.col(f"{k}_{c}") for c in SUMS} for k in "ab")
    if method == "surprise":
        gain = _surprise(F.col("ti") + F.col("lp"), F.col("tk") + 2 * a["n"] * b["n"]) - _surprise(F.col("ti"), F.col("tk"))
    else:
        both = {c: a[c] + b[c] for c in SUMS}
        both |= {"ip": both["ip"] + F.col("lp"), "iq": both["iq"] + F.col("lq")}
        gain = _value(method, both) - _value(method, a) - _value(method, b)
    return rows.select("run", "a", "b", gain.alias("gain"))


def agglomerate(edges: DataFrame, nodes: DataFrame, method: str = "surprise", gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """node, comm: joins communities, from single nodes on, until no join of two raises the quality.

    A round joins the pairs that are each other's best.
    """
    e = stored(_split(edges), "split")
    now = stored(_sized(nodes.select("node", F.col("node").alias("comm")).distinct()), "single")
    while True:
        seed += 1
        pairs = stored(_merges(e, now, method, gamma).where(F.col("gain") > LEAST_GAIN), "pairs")
        best = F.struct("gain", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        first = pairs.select("run", best.alias("x"), F.explode(F.array("a", "b")).alias("end")).groupBy("run", "end").agg(F.max("x").alias("x"))
        mutual = first.groupBy("run", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        # the later community of a pair goes into the earlier one
        moves = mutual.select("run", (-F.col("x.b")).alias("key"), (-F.col("x.b")).alias("a"), (-F.col("x.a")).alias("b"), F.col("x.gain").alias("gain"))
        step = _step(e, now, moves, "comm", method, gamma, seed)
        if step is None:
            return now.select("node", "comm")
        now = step


def resolutions(edges: DataFrame, nodes: DataFrame, method: str, low: float, high: float, least: float, seed: int = 1) -> DataFrame:
    """gamma, communities, quality, within: the profile between two resolutions.

    ``within`` is what the resolution multiplies: the sum of n * n (cpm) or of expected
    weights (configuration).  An interval is halved while ``within`` differs at its ends
    and it is longer than ``least``.  All resolutions of one width are optimised
    together, the resolution being a key.
    """
    if method not in ("cpm", "configuration"):
        raise ValueError(f"{method} has no resolution that its quality is linear in")
    found: dict[float, tuple] = {}
    spark, todo = edges.sparkSession, [low, high]
    while todo:
        runs = spark.createDataFrame(list(enumerate(todo)), "run bigint, gamma double")
        keyed = stored(edges.join(F.broadcast(runs)).select("run", "src", "dst", "w"), "keyed")  # the graph once for each resolution
        p = best_of_runs(keyed, nodes.join(F.broadcast(runs)).select("run", "node", "gamma"), method, seed=seed)
        p = stored(p.join(F.broadcast(runs), "run").select("run", "node", "comm", "gamma"), "profile")
        q = lambda more, p=p, keyed=keyed: _qualities(_split(keyed), _sized(p.withColumn("gamma", F.col("gamma") + more)), method, 0.0)
        both = q(0.0).join(q(1.0).withColumnRenamed("quality", "other"), "run").join(p.groupBy("run").agg(F.count_distinct("comm").alias("n")), "run").join(F.broadcast(runs), "run")
        found |= {r["gamma"]: (r["gamma"], r["n"], r["quality"], r["quality"] - r["other"]) for r in both.collect()}  # a row for each resolution
        at = sorted(found)
        todo = [(a + b) / 2 for a, b in zip(at[:-1], at[1:], strict=True) if b - a > least and abs(found[a][3] - found[b][3]) > LEAST_GAIN]
    return spark.createDataFrame(sorted(found.values()), "gamma double, communities bigint, quality double, within double")
