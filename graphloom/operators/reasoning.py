"""Consistency checks, temporal, probabilistic and fuzzy operators, embeddings, mining and completion, on columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.lineage import cut
from graphloom.sources.graphs import Graph, TableGraph, TableMap, union

OWL, RDFS = terms.OWL, terms.RDFS
VIOLATION = ("check", "subject", "detail")


# consistency
def _typed(graph: Graph, kind: str) -> DataFrame:
    return _small(graph.scan(p=terms.TYPE, o=f"<{OWL}{kind}>").select(F.col("s").alias("property")).distinct())


#: Rows of a schema, or of what else goes by predicates and classes, that are sent to all tasks.
MOST_SCHEMA = 2000


def _small(df: DataFrame) -> DataFrame:
    """df, which goes to all tasks if it is no larger than schemas are: joined by predicates, that few rows would gather
    all triples of a predicate in one task."""
    df = cut(df)
    return F.broadcast(df) if df.limit(MOST_SCHEMA + 1).count() <= MOST_SCHEMA else df


def disjoint_classes(graph: Graph) -> DataFrame:
    """Individuals in two disjoint classes."""
    types = graph.scan(p=terms.TYPE).select("s", F.col("o").alias("c"))
    pairs = _small(graph.scan(p=f"<{OWL}disjointWith>").select(F.col("s").alias("a"), F.col("o").alias("b")))
    both = types.join(pairs, F.col("c") == F.col("a")).join(types.select(F.col("s").alias("s2"), F.col("c").alias("c2")), (F.col("s") == F.col("s2")) & (F.col("b") == F.col("c2")))
    return both.select(F.lit("disjoint").alias("check"), F.col("s").alias("subject"), F.concat_ws(" ", "a", "b").alias("detail")).distinct()


def functional(graph: Graph, inverse: bool = False) -> DataFrame:
    """Subjects with several objects of a functional property; objects with several subjects of an inverse one."""
    kind, key, other = ("InverseFunctionalProperty", "o", "s") if inverse else ("FunctionalProperty", "s", "o")
    t = graph.triples.join(_typed(graph, kind), F.col("p") == F.col("property"))
    many = t.groupBy(key, "p").agg(F.count_distinct(other).alias("n")).where("n > 1")
    return many.select(F.lit(kind).alias("check"), F.col(key).alias("subject"), F.concat_ws(" ", "p", F.col("n").cast("string")).alias("detail"))


def domain_range(graph: Graph) -> DataFrame:
    """Typed individuals that lack the class a property's domain or range asks for."""
    types = graph.scan(p=terms.TYPE).select(F.col("s").alias("x"), F.col("o").alias("class"))
    out = []
    for name, place in (("domain", "s"), ("range", "o")):
        schema = _small(graph.scan(p=f"<{RDFS}{name}>").select(F.col("s").alias("p"), F.col("o").alias("class")))
        used = graph.triples.join(schema, "p").select(F.col(place).alias("x"), "class", "p").distinct()
        wrong = used.join(types.select("x").distinct(), "x", "left_semi").join(types, ["x", "class"], "left_anti")
        out.append(wrong.select(F.lit(name).alias("check"), F.col("x").alias("subject"), F.concat_ws(" ", "p", "class").alias("detail")))
    return union(out)


def identity(graph: Graph) -> DataFrame:
    """Pairs said to be the same and different."""
    same = graph.scan(p=f"<{OWL}sameAs>").select("s", "o")
    different = graph.scan(p=f"<{OWL}differentFrom>").select("s", "o")
    either = different.union(different.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return same.join(either.distinct(), ["s", "o"]).select(F.lit("identity").alias("check"), F.col("s").alias("subject"), F.col("o").alias("detail"))


def nothing(graph: Graph) -> DataFrame:
    return graph.scan(p=terms.TYPE, o=f"<{OWL}Nothing>").select(F.lit("nothing").alias("check"), F.col("s").alias("subject"), F.col("o").alias("detail"))


def characteristics(graph: Graph) -> DataFrame:
    """Asymmetric properties that hold both ways, irreflexive ones of a node with itself."""
    t = graph.triples
    one = t.join(_typed(graph, "AsymmetricProperty"), F.col("p") == F.col("property")).select("s", "p", "o")
    back = one.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    asymmetric = one.join(back, ["s", "p", "o"]).select(F.lit("asymmetric").alias("check"), F.col("s").alias("subject"), F.concat_ws(" ", "p", "o").alias("detail"))
    loops = t.where("s = o").join(_typed(graph, "IrreflexiveProperty"), F.col("p") == F.col("property"))
    return asymmetric.union(loops.select(F.lit("irreflexive").alias("check"), F.col("s").alias("subject"), F.col("p").alias("detail")))


def violations(graph: Graph) -> DataFrame:
    """All checks: (check, subject, detail)."""
    return union([disjoint_classes(graph), functional(graph), functional(graph, True), domain_range(graph), identity(graph), nothing(graph), characteristics(graph)])


# time
def allen(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Which of the 13 relations holds between the intervals [a1, a2] and [b1, b2]."""
    return (
        F.when((a1 == b1) & (a2 == b2), "equals").when(a2 < b1, "before").when(a1 > b2, "after").when(a2 == b1, "meets").when(a1 == b2, "metBy")
        .when((a1 == b1) & (a2 < b2), "starts").when((a1 == b1) & (a2 > b2), "startedBy").when((a2 == b2) & (a1 > b1), "finishes").when((a2 == b2) & (a1 < b1), "finishedBy")
        .when((a1 > b1) & (a2 < b2), "during").when((a1 < b1) & (a2 > b2), "contains").when((a1 < b1) & (a2 > b1) & (a2 < b2), "overlaps").otherwise("overlappedBy")
    )


def relations(intervals: DataFrame, key: str | None = None) -> DataFrame:
    """Relations of the intervals (id, start, end) within the same ``key``: (a, b, relation), each unordered pair once.
    Pairs are what is asked for, so a key bounds them."""
    on = [key] if key else []
    a = intervals.select(*on, F.col("id").alias("a"), F.col("start").alias("a1"), F.col("end").alias("a2"))
    b = intervals.select(*on, F.col("id").alias("b"), F.col("start").alias("b1"), F.col("end").alias("b2"))
    pairs = (a.join(b, on) if on else a.crossJoin(b)).where("a < b")
    return pairs.select("a", "b", allen(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("relation"))


def valid_at(temporal: DataFrame, instant) -> DataFrame:
    """Rows valid at the instant; an open end has no bound."""
    return temporal.where((F.col("valid_from").isNull() | (F.col("valid_from") <= instant)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= instant)))


def valid_during(temporal: DataFrame, start, end) -> DataFrame:
    return temporal.where((F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start)))


# probability
COMBINE = {
    "product": lambda ps: reduce(lambda a, b: a * b, ps),
    "minimum": lambda ps: F.least(*ps) if len(ps) > 1 else ps[0],
    "harmonic": lambda ps: F.lit(float(len(ps))) / reduce(lambda a, b: a + b, [1 / p for p in ps]),
    "noisy_and": lambda ps: 0.01 + 0.99 * reduce(lambda a, b: a * b, ps),
}


def aggregate_probability(df: DataFrame, method: str = "noisy_or") -> DataFrame:
    """One probability for each triple: max, noisy_or, average, or first (by source)."""
    made = {"max": F.max("prob"), "noisy_or": 1 - F.product(1 - F.col("prob")), "average": F.avg("prob"), "first": F.min_by("prob", "source") if "source" in df.columns else F.first("prob")}[method]
    return df.groupBy("s", "p", "o").agg(made.alias("prob"))


def dempster_shafer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dempster's rule for two mass tables (hypotheses: sorted array, mass): frames of discernment are small."""
    joint = a.crossJoin(b.select(F.col("hypotheses").alias("h2"), F.col("mass").alias("m2")))
    met = joint.select(F.array_sort(F.array_intersect("hypotheses", "h2")).alias("hypotheses"), (F.col("mass") * F.col("m2")).alias("mass")).groupBy("hypotheses").agg(F.sum("mass").alias("mass"))
    conflict = F.coalesce(F.sum(F.when(F.size("hypotheses") == 0, F.col("mass"))).over(Window.partitionBy(F.lit(1))), F.lit(0.0))
    return met.withColumn("__k", conflict).where(F.size("hypotheses") > 0).select("hypotheses", (F.col("mass") / (1 - F.col("__k"))).alias("mass"))


def belief(masses: DataFrame, hypotheses: list) -> DataFrame:
    """Belief and plausibility of a set of hypotheses."""
    h = F.array(*map(F.lit, hypotheses))
    inside, touches = F.size(F.array_except("hypotheses", h)) == 0, F.arrays_overlap("hypotheses", h)
    return masses.agg(F.coalesce(F.sum(F.when(inside, F.col("mass"))), F.lit(0.0)).alias("belief"), F.coalesce(F.sum(F.when(touches, F.col("mass"))), F.lit(0.0)).alias("plausibility"))


# fuzzy sets
def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


MEMBERSHIP = {
    "triangular": lambda x, a, b, c: F.greatest(F.lit(0.0), F.least((x - a) / (b - a), (c - x) / (c - b))),
    "trapezoidal": lambda x, a, b, c, d: F.greatest(F.lit(0.0), F.least((x - a) / (b - a), F.lit(1.0), (d - x) / (d - c))),
    "gaussian": lambda x, mean, sigma: F.exp(-((x - mean) ** 2) / (2 * sigma * sigma)),
    "bell": lambda x, a, b, c: 1 / (1 + F.pow(F.abs((x - c) / a), F.lit(2.0 * b))),
    "sigmoid": lambda x, a, c: 1 / (1 + F.exp(-a * (x - c))),
    "s_shaped": lambda x, a, b: F.when(x <= a, 0.0).when(x <= (a + b) / 2, 2 * ((x - a) / (b - a)) ** 2).when(x <= b, 1 - 2 * ((x - b) / (b - a)) ** 2).otherwise(1.0),
    "z_shaped": lambda x, a, b: 1 - MEMBERSHIP["s_shaped"](x, a, b),
    "singleton": lambda x, a: F.when(x == a, 1.0).otherwise(0.0),
    "linear": lambda x, a, b: _clip((x - a) / (b - a)),
}
HEDGES = {"very": lambda m: m * m, "somewhat": F.sqrt, "extremely": lambda m: m**3, "more": lambda m: F.pow(m, F.lit(1.25)), "less": lambda m: F.pow(m, F.lit(0.75)), "not": lambda m: 1 - m}
T_NORMS = {"minimum": lambda a, b: F.least(a, b), "product": lambda a, b: a * b, "lukasiewicz": lambda a, b: F.greatest(F.lit(0.0), a + b - 1), "drastic": lambda a, b: F.when(a == 1, b).when(b == 1, a).otherwise(0.0)}
S_NORMS = {"maximum": lambda a, b: F.greatest(a, b), "probabilistic": lambda a, b: a + b - a * b, "bounded": lambda a, b: F.least(F.lit(1.0), a + b), "drastic": lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(1.0)}


def mamdani(df: DataFrame, key: str, rules: list[tuple[Column, str, tuple]], low: float, high: float, samples: int = 101, larsen: bool = False) -> DataFrame:
    """The aggregated output of rules (firing degree, output shape, its parameters) on a grid: (key, x, degree)."""
    grid = df.select(key, *[f.alias(f"__f{i}") for i, (f, _, _) in enumerate(rules)], F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("__i"))
    x = F.lit(low) + F.col("__i") * ((high - low) / (samples - 1))
    shaped = [(F.col(f"__f{i}") * m if larsen else F.least(F.col(f"__f{i}"), m)) for i, m in enumerate(MEMBERSHIP[s](x, *args) for _, s, args in rules)]
    return grid.select(key, x.alias("x"), (F.greatest(*shaped) if len(shaped) > 1 else shaped[0]).alias("degree"))


def defuzzify(points: DataFrame, key: str, method: str = "centroid") -> DataFrame:
    """One value for each key: centroid (also weighted), bisector, mean, smallest or largest of maxima."""
    if method in ("centroid", "weighted"):
        return points.groupBy(key).agg(F.try_divide(F.sum(F.col("x") * F.col("degree")), F.sum("degree")).alias("value"))
    if method == "bisector":
        order = Window.partitionBy(key).orderBy("x")
        run = points.withColumn("__run", F.sum("degree").over(order)).withColumn("__all", F.sum("degree").over(Window.partitionBy(key)))
        return run.where("__run * 2 >= __all").groupBy(key).agg(F.min("x").alias("value"))
    top = points.withColumn("__m", F.max("degree").over(Window.partitionBy(key))).where("degree = __m")
    return top.groupBy(key).agg({"mom": F.avg("x"), "som": F.min("x"), "lom": F.max("x")}[method].alias("value"))


def sugeno(weights: list[Column], values: list[Column]) -> Column:
    return F.try_divide(reduce(lambda a, b: a + b, [w * v for w, v in zip(weights, values, strict=True)]), reduce(lambda a, b: a + b, weights))


# embeddings
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def most_similar(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar vectors: each task keeps its own best."""
    return vectors.select(id_col, cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


#: Vectors and query vectors that meet in one task, and the similarities that it holds at once.
VECTOR_BLOCK, QUERY_BLOCK, MOST_ALIKE = 16384, 2048, 1 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, place): of each query vector the k vectors of the highest cosine, ties by id.

    Both sides are dealt to blocks of bounded size; each pair of blocks meets once, in numpy, some queries at a time, and
    keeps k for each query, so what is shuffled back is k rows for each query and block. Vectors of norm 0 or null have similarity 0.
    """
    import numpy as np
    import pyarrow as pa

    n_vectors, n_queries = vectors.count(), queries.count()
    v_blocks, q_blocks = 1 + n_vectors // VECTOR_BLOCK, 1 + n_queries // QUERY_BLOCK
    deal = lambda df, own, n, other, m: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(vectors, "__v", v_blocks, "__q", q_blocks), deal(queries, "__q", q_blocks, "__v", v_blocks)

    def unit(rows):
        x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norms > 0, norms, 1)

    def meet(some, asked):
        if not some.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        some = some.sort_by("id")
        ids, vectors_, queries_ = some["id"].to_numpy(), unit(some).T, unit(asked)
        step, found, alike_ = max(1, MOST_ALIKE // len(ids)), [], []
        for a in range(0, len(queries_), step):
            alike = np.round(queries_[a : a + step] @ vectors_, 9)
            best = np.argsort(-alike, axis=1, kind="stable")[:, :k]
            found.append(ids[best])
            alike_.append(np.take_along_axis(alike, best, 1))
        found, alike_ = np.concatenate(found), np.concatenate(alike_)
        return pa.table({"query_id": pa.array(np.repeat(asked["id"].to_numpy(), found.shape[1])), "id": pa.array(found.reshape(-1)), "similarity": pa.array(alike_.reshape(-1))})

    found = left.groupBy("__v", "__q").cogroup(right.groupBy("__v", "__q")).applyInArrow(meet, "query_id bigint, id bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("id", id_col)


def transe_score(h: Column, r: Column, t: Column) -> Column:
    """The negative distance of head plus relation from the tail."""
    return -euclidean(F.zip_with(h, r, lambda x, y: x + y), t)


# mining and completion
#: Predicates that a subject's row has a bit for.
MOST_PREDICATES = 630


def predicate_pairs(graph: Graph) -> DataFrame:
    """Predicates that occur with the same subjects: (p1, p2, support, confidence)."""
    names = [r.p for r in graph.triples.select("p").where("p is not null").distinct().limit(MOST_PREDICATES + 1).collect()]
    if len(names) > MOST_PREDICATES:
        sp = graph.triples.select("s", "p").distinct()
        each = sp.groupBy("p").agg(F.count("*").alias("n"))
        pairs = sp.select("s", F.col("p").alias("p1")).join(sp.select("s", F.col("p").alias("p2")), "s").where("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("support"))
        return pairs.join(each.select(F.col("p").alias("p1"), "n"), "p1").select("p1", "p2", "support", (F.col("support") / F.col("n")).alias("confidence"))
    # a bit for each predicate: a subject is one row, and subjects with the same predicates are counted together
    names.sort()
    words = [names[i : i + 63] for i in range(0, len(names), 63)] or [[]]
    bit = lambda part: F.coalesce(F.try_element_at(F.create_map(*[x for i, n in enumerate(part) for x in (F.lit(n), F.lit(1 << i).cast("bigint"))]), F.col("p")), F.lit(0).cast("bigint")) if part else F.lit(0).cast("bigint")
    has = graph.triples.where("s is not null and p is not null").groupBy("s").agg(*[F.bit_or(bit(part)).alias(f"__w{i}") for i, part in enumerate(words)])
    kinds = has.groupBy(*[f"__w{i}" for i in range(len(words))]).agg(F.count("*").alias("__k"))
    every = F.array(*[F.when(F.col(f"__w{k // 63}").bitwiseAND(F.lit(1 << k % 63).cast("bigint")) != 0, F.lit(n)) for k, n in enumerate(names)]) if names else F.array().cast("array<string>")
    kinds = cut(kinds.select("__k", F.filter(every, lambda x: x.isNotNull()).alias("__p")))
    each = kinds.select("__k", F.explode("__p").alias("p1")).groupBy("p1").agg(F.sum("__k").alias("n"))
    pairs = kinds.select("__k", "__p", F.explode("__p").alias("p1")).select("__k", "p1", F.explode("__p").alias("p2")).where("p1 <> p2").groupBy("p1", "p2").agg(F.sum("__k").alias("support"))
    return pairs.join(each, "p1").select("p1", "p2", "support", (F.col("support") / F.col("n")).alias("confidence"))


def predict_by_type(graph: Graph, entity: str, predicate: str, k: int = 10) -> DataFrame:
    """Objects likely for (entity, predicate, ?): those that share most types with known objects of the predicate."""
    types = graph.scan(p=terms.TYPE).select(F.col("s").alias("x"), F.col("o").alias("class"))
    known = graph.scan(p=predicate)
    wanted = known.select(F.col("o").alias("x")).distinct().join(types, "x").select("class").distinct()
    total = types.groupBy("x").agg(F.count("*").alias("n"))
    overlap = types.join(wanted, "class").groupBy("x").agg(F.count("*").alias("m"))
    taken = known.where(F.col("s") == entity).select(F.col("o").alias("x"))
    return overlap.join(total, "x").join(taken, "x", "left_anti").select("x", (F.col("m") / F.col("n")).alias("confidence")).orderBy(F.desc("confidence"), "x").limit(k)


def statistics(graph: Graph) -> DataFrame:
    """Numbers of triples and of distinct subjects, predicates and objects. Tables are counted by columns: keys and values
    are made distinct as they lie, before they become terms."""
    if isinstance(graph, TableGraph):
        t = graph.spark.createDataFrame([], "triples bigint, p string") if not graph.maps else union([x for m in graph.maps.values() for x in _counts(graph, m)])
        subjects = union([graph.table(m.name).select(*m.key).distinct().select(m.subject().alias("t")) for m in graph.maps.values()]) if graph.maps else t.select(F.col("p").alias("t"))
        values = [graph.table(m.name).select(c).where(F.col(c).isNotNull()).distinct().select(m.object(c).alias("t")) for m in graph.maps.values() for c in m.columns]
        objects = union([*values, *[graph.table(m.name).limit(1).select(F.lit(m.type_iri).alias("t")) for m in graph.maps.values()]]) if graph.maps else subjects
        number = lambda df, name: df.where("t is not null").distinct().agg(F.count("*").alias(name))
        whole = t.agg(F.coalesce(F.sum("triples"), F.lit(0)).cast("bigint").alias("triples"), F.count_distinct(F.when(F.col("triples") > 0, F.col("p"))).alias("predicates"))
        return whole.crossJoin(number(subjects, "subjects")).crossJoin(number(objects, "objects")).select("triples", "subjects", "predicates", "objects")
    t = graph.triples
    return t.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"))


def _counts(graph: TableGraph, m: TableMap) -> list[DataFrame]:
    """(triples, p): how many triples a table has of each predicate."""
    names = [(terms.TYPE, F.count("*")), *((f"<t:{c}>", F.count(c)) for c in m.columns)]
    row = graph.table(m.name).agg(*[n.alias(f"n{i}") for i, (_, n) in enumerate(names)])
    return [row.select(F.explode(F.array(*[F.struct(F.col(f"n{i}").alias("triples"), F.lit(p).alias("p")) for i, (p, _) in enumerate(names)])).alias("x")).select("x.triples", "x.p")]


def link_entities(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Entities (entity, label) whose label stands as words in a text (id, text)."""
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("word"))
    first = labels.select("entity", F.lower("label").alias("label"), F.split_part(F.lower("label"), F.lit(" "), F.lit(1)).alias("word"))
    near = words.join(first, "word").join(texts.select("id", F.lower("text").alias("lower")), "id")
    return near.where(F.contains(F.col("lower"), F.col("label"))).select("id", "entity").distinct()


# uncertain and fuzzy triples, intervals, types
def probable(facts: DataFrame, rules: list, confidence: float = 1.0, method: str = "product", least: float = 0.01, max_steps: int = 50) -> DataFrame:
    """(s, p, o, prob): the facts and what rules conclude from them. A conclusion's probability is that of its premises,
    combined by ``method``, times the rules' confidence; what falls short of ``least`` is left out, a triple that is
    known keeps its probability, and of several ways found in one step the likeliest counts."""
    from graphloom.plans.rules import is_data

    known = cut(facts.select("s", "p", "o", F.col("prob").cast("double").alias("prob")))
    for _ in range(max_steps):
        made = []
        for r in rules:
            atoms, out, names = [a for a in r.body if is_data(a)], None, []
            for i, a in enumerate(atoms):
                part, columns = known, {}
                for place, t in zip("spo", a, strict=True):
                    if t.startswith("?") and t[1:] in columns:
                        part = part.where(columns[t[1:]] == F.col(place))
                    elif t.startswith("?"):
                        columns[t[1:]] = F.col(place)
                    else:
                        part = part.where(F.col(place) == t)
                part = part.select(*[c.alias(v) for v, c in columns.items()], F.col("prob").alias(f"__p{i}"))
                shared = [v for v in columns if v in names]
                out = part if out is None else out.join(part, shared) if shared else out.crossJoin(part)
                names += [v for v in columns if v not in names]
            chance = COMBINE[method]([F.col(f"__p{i}") for i in range(len(atoms))]) * confidence
            place = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
            made += [out.select(*[place(t).alias(c) for c, t in zip("spo", h, strict=True)], chance.alias("prob")).where(F.col("prob") >= least) for h in r.head]
        new = cut(union(made).groupBy("s", "p", "o").agg(F.max("prob").alias("prob")).join(known, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    return known


def certain(facts: DataFrame, least: float) -> Graph:
    """The triples of at least this probability, as plain ones."""
    return Graph(facts.where(F.col("prob") >= least).select("s", "p", "o").distinct())


def fuzzy_types(graph: Graph, predicate: str, sets: dict[str, Callable[[Column], Column]], least: float = 0.0) -> DataFrame:
    """(s, p, o, degree): how far each subject is in each fuzzy set (class: membership of the predicate's number)."""
    found = graph.scan(p=predicate).select("s", terms.number(F.col("o")).alias("x")).where("x is not null")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("o"), f(F.col("x")).cast("double").alias("degree")) for c, f in sets.items()])).alias("t")
    return found.select("s", F.lit(terms.TYPE).alias("p"), each).select("s", "p", "t.o", "t.degree").where(F.col("degree") > least)


def intervals(graph: Graph, beginning: str, end: str, instant: str) -> DataFrame:
    """(id, start, end): subjects whose beginning and end are instants with a date and time."""
    when = graph.scan(p=instant).select(F.col("s").alias("__i"), F.try_to_timestamp(terms.value(F.col("o"))).alias("__t"))
    side = lambda p, name: graph.scan(p=p).select(F.col("s").alias("id"), F.col("o").alias("__i")).join(when, "__i").select("id", F.col("__t").alias(name))
    return side(beginning, "start").join(side(end, "end"), "id").where("start is not null and end is not null")


def entity_types(graph: Graph, least: float = 0.0) -> DataFrame:
    """(s, class, confidence): types of each subject, those it has with confidence 1, others by the share of subjects
    with the same predicate that have them."""
    types = graph.scan(p=terms.TYPE).select("s", F.col("o").alias("class")).distinct()
    uses = graph.triples.where(F.col("p") != terms.TYPE).select("s", "p").distinct()
    size = uses.groupBy("p").agg(F.count("*").alias("n"))
    share = _small(uses.join(types, "s").groupBy("p", "class").agg(F.count("*").alias("m")).join(size, "p").select("p", "class", (F.col("m") / F.col("n")).alias("confidence")))
    likely = uses.join(share, "p").groupBy("s", "class").agg(F.max("confidence").alias("confidence"))
    return likely.unionByName(types.withColumn("confidence", F.lit(1.0))).groupBy("s", "class").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") > least)
