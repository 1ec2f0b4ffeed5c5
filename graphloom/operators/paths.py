"""Property paths as relations (s, o), and transitive closure by semi-naive rounds of joins."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut

if TYPE_CHECKING:
    from graphloom.plans.algebra import Path
    from graphloom.sources.graphs import Graph


#: Rounds whose finds are kept apart before they are written as one.
MOST_PARTS = 6
#: Nodes of one line that meet in one task, at most as many with as many; seeds from which ways are followed edge by edge.
LINE_BLOCK, FEW_SEEDS = 1024, 10_000


def _follow(left: DataFrame, right: DataFrame) -> DataFrame:
    after = right.select(F.col("s").alias("__from"), F.col("o").alias("__to"))
    return left.join(after, F.col("o") == F.col("__from")).select("s", F.col("__to").alias("o"))


def closure(edges: DataFrame, seeds: DataFrame | None = None, beyond: bool = False) -> DataFrame:
    """All pairs (s, o) with a way of one edge or more, from the seeds (s) if given; ``beyond``: but the edges.

    Edges that neither branch nor merge make lines and rings: their nodes are numbered, and each pair is made once, when
    it is read. Others go by rounds (see ``_doubled``). From few seeds each round extends by one edge only the pairs that
    the last one found, so that nothing beyond their reach is touched. Cycles end it as no pair is new.
    """
    step = cut(edges.select("s", "o").distinct())
    if seeds is not None:
        seeds = seeds.select("s").distinct()
    if seeds is None or seeds.limit(FEW_SEEDS + 1).count() > FEW_SEEDS:
        found = lines(step)
        if found is not None:
            return _along(*found, step, seeds, beyond)
    out = _doubled(step) if seeds is None else _stepwise(step, seeds)
    return out.join(step, ["s", "o"], "left_anti") if beyond else out


def _stepwise(step: DataFrame, seeds: DataFrame) -> DataFrame:
    delta = cut(step.join(seeds, "s", "left_semi"))
    known = [delta]
    while not delta.isEmpty():
        every = reduce(DataFrame.unionByName, known)
        delta = cut(_follow(delta, step).distinct().join(every, ["s", "o"], "left_anti"))
        known.append(delta)
        if len(known) > MOST_PARTS:
            known = [cut(reduce(DataFrame.unionByName, known))]
    return reduce(DataFrame.unionByName, known)


def _doubled(step: DataFrame) -> DataFrame:
    """By the pairs whose shortest way has 1, 2, 4 .. edges: a shortest way of fewer than twice as many starts with a known
    shorter one and ends with one of these. So a round joins what is known once, with these pairs alone, and the number
    of rounds grows with the logarithm of the longest way."""
    shorter: list[DataFrame] = []
    exact = step
    while True:
        every = [*shorter, exact]
        if shorter:
            found = _follow(reduce(DataFrame.unionByName, shorter), exact).distinct()
            every.append(cut(found.join(reduce(DataFrame.unionByName, every), ["s", "o"], "left_anti")))
        shorter = every if len(every) <= MOST_PARTS else [cut(reduce(DataFrame.unionByName, every))]
        known = reduce(DataFrame.unionByName, shorter)
        exact = cut(_follow(exact, exact).distinct().join(known, ["s", "o"], "left_anti"))
        if exact.isEmpty():
            return known


def lines(step: DataFrame) -> tuple[DataFrame, bool] | None:
    """Of distinct edges that neither branch nor merge: (n, line, at), each node with its line's first node and its place
    from there, or with its ring's least node and null; and whether there are rings. None for other edges.

    Each node's pointer to an earlier one doubles its reach in a round, until it comes to the line's first node. Once a
    round no longer settles any, rings are left, where pointers go on until the least node within reach is the ring's.
    """
    if any(not x.isEmpty() for x in (step.where("s is null or o is null"), *(step.groupBy(c).count().where("count > 1") for c in ("s", "o")))):
        return None
    open_ = step.select(F.col("o").alias("n"), F.col("s").alias("to"), F.lit(1).cast("bigint").alias("d"), F.lit(False).alias("done"), F.least("s", "o").alias("low"))
    settled: list[DataFrame] = []
    left, ringed = step.count(), False
    while left:
        every = open_ if ringed else reduce(DataFrame.unionByName, [*settled, open_])
        r = every.select(F.col("n").alias("__n"), F.col("to").alias("__to"), F.col("d").alias("__d"), F.col("done").alias("__done"), F.col("low").alias("__low"))
        further = F.col("__n").isNotNull()
        moved = cut(open_.join(r, F.col("to") == F.col("__n"), "left").select(
            "n", F.coalesce("__to", "to").alias("to"), F.when(further, F.col("d") + F.col("__d")).otherwise(F.col("d")).alias("d"), (~further | F.col("__done")).alias("done"),
            F.least("low", "__low").alias("low"), (further & (F.col("__low") < F.col("low"))).alias("lower")))
        open_ = moved.where("not done").drop("lower")
        still, lower = moved.where("not done").agg(F.count("*"), F.coalesce(F.bool_or("lower"), F.lit(False))).first()
        if still < left:
            settled.append(moved.where("done").drop("lower"))
        else:
            if ringed and not lower:
                break
            ringed = True
        left = still
    out = [x.select("n", F.col("to").alias("line"), F.col("d").alias("at")) for x in settled]
    out += [x.where("d = 1").select(F.col("to").alias("n"), F.col("to").alias("line"), F.lit(0).cast("bigint").alias("at")) for x in settled[:1]]
    if ringed or not out:
        out.append(open_.select("n", F.col("low").alias("line"), F.lit(None).cast("bigint").alias("at")))
    return reduce(DataFrame.unionByName, out), ringed


def _along(places: DataFrame, ringed: bool, step: DataFrame, seeds: DataFrame | None, beyond: bool) -> DataFrame:
    """The pairs along lines and around rings. A long line's nodes are dealt to blocks, which meet in pairs."""
    sizes = places.where(F.col("at").isNull()).groupBy("line").agg(F.count("*").alias("size")).where(F.col("size") > LINE_BLOCK) if ringed else None
    long = places.where(F.col("at") >= LINE_BLOCK).groupBy("line").agg((F.max("at") + 1).alias("size"))
    long = long if sizes is None else long.unionByName(sizes)
    a, b = places, places
    on = ["line"]
    if not long.isEmpty():
        blocks = F.broadcast(cut(long.select("line", F.ceil(F.col("size") / LINE_BLOCK).cast("int").alias("__blocks"))))
        dealt = places.join(blocks, "line", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        dealt = dealt.withColumn("__block", F.coalesce(F.floor(F.col("at") / LINE_BLOCK).cast("int"), F.pmod(F.xxhash64("n"), F.col("__blocks")).cast("int")))
        first = F.when(F.col("at").isNull(), 0).otherwise(F.col("__block"))
        a = dealt.select("n", "line", "at", F.explode(F.sequence(first, F.col("__blocks") - 1)).alias("__block"))
        b, on = dealt.drop("__blocks"), ["line", "__block"]
    if seeds is not None:
        a = a.join(seeds.withColumnRenamed("s", "n"), "n", "left_semi")
    far = 2 if beyond else 1
    if ringed and beyond:
        b = b.join(step.select(F.col("o").alias("n"), F.col("s").alias("__before")), "n", "left")
    b = b.withColumnsRenamed({"n": "__o", "at": "__at"})
    met = F.col("__at") - F.col("at") >= far
    if ringed:
        met = met | (F.col("at").isNull() & ((F.col("__before") != F.col("n")) if beyond else F.lit(True)))
    # small sides that make many rows: dealt to all partitions by number, which Spark doesn't merge by their size
    n = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.sparkSession.sparkContext.defaultParallelism)
    return a.repartition(n, *on).join(b.repartition(n, *on), on).where(met).select(F.col("n").alias("s"), F.col("__o").alias("o"))


def nodes(graph: Graph) -> DataFrame:
    """All subjects and objects, as pairs of each with itself."""
    t = graph.triples
    found = t.select(F.col("s").alias("n")).union(t.select(F.col("o").alias("n"))).distinct()
    return found.select(F.col("n").alias("s"), F.col("n").alias("o"))


def evaluate(graph: Graph, path: Path | str, subject: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """The path's relation; a bound subject, or nodes (s) it is asked for, restrict where closures start. Sequences keep
    duplicates, other steps that merge ways don't."""
    if isinstance(path, str):
        return graph.scan(p=path).select("s", "o")
    seeded = (lambda df: df.where(F.col("s") == subject)) if subject is not None else (lambda df: df)
    op, args = path.op, path.args
    if op == "pred":
        return seeded(graph.scan(p=args[0]).select("s", "o"))
    if op == "inv":
        return seeded(evaluate(graph, args[0]).select(F.col("o").alias("s"), F.col("s").alias("o")))
    if op == "seq":
        first = evaluate(graph, args[0], subject)
        for nxt in args[1:]:
            right = evaluate(graph, nxt).select(F.col("s").alias("__mid"), F.col("o").alias("__end"))
            first = first.join(right, F.col("o") == F.col("__mid")).select("s", F.col("__end").alias("o"))
        return first
    if op == "alt":
        return reduce(DataFrame.union, [evaluate(graph, a, subject) for a in args]).distinct()
    if op == "neg":
        return seeded(graph.triples.where(~F.col("p").isin(list(args))).select("s", "o"))
    edges = evaluate(graph, args[0])
    seeds = graph.spark.createDataFrame([(subject,)], "s string") if subject is not None else among
    if among is not None:
        seeded = lambda df: df.join(among, "s", "left_semi")
    if op == "plus":
        return closure(edges, seeds)
    zero = seeds.select("s", F.col("s").alias("o")) if seeds is not None else nodes(graph)
    more = closure(edges, seeds) if op == "star" else seeded(edges).distinct()
    return zero.unionByName(more.where("s <> o").select("s", "o"))  # a node reaches itself by no edge at all


def bind_path(graph: Graph, s: str, path: Path, o: str, among: DataFrame | None = None) -> DataFrame:
    """A path pattern's bindings, among the given nodes (s) at least. A bound object with an unbound subject is answered from the object backwards."""
    from graphloom.plans.algebra import Path as P

    if not o.startswith("?") and s.startswith("?"):
        found = evaluate(graph, P("inv", (path,)) if path.op not in ("star", "plus", "opt") else P(path.op, (P("inv", path.args),)), o)
        return found.where(F.col("s") == o).select(F.col("o").alias(s[1:]))
    found = evaluate(graph, path, None if s.startswith("?") else s, among if s.startswith("?") else None)
    for place, t in (("s", s), ("o", o)):
        if not t.startswith("?"):
            found = found.where(F.col(place) == t)
    if s == o:
        found = found.where("s = o")
    columns = {t[1:]: F.col(place) for place, t in (("o", o), ("s", s)) if t.startswith("?")}
    return found.select(*[c.alias(v) for v, c in columns.items()]) if columns else found.select(F.lit(1).alias("__match")).limit(1)
