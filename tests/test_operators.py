"""Temporal, probabilistic, fuzzy, embedding and stream operators; provers and worlds; caches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cache, language, provers, reasoning, rulesets, worlds
from graphloom.sources.graphs import TRIPLE, Graph
from graphloom.streaming.reactive import CHANGES, Reactive


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_allen(spark):
    spans = {"equals": (1, 4), "before": (6, 9), "meets": (4, 9), "starts": (1, 9), "during": (0, 9), "finishes": (0, 4), "overlaps": (2, 9), "contains": (2, 3), "after": (-3, 0), "metBy": (-3, 1), "startedBy": (1, 2), "finishedBy": (2, 4), "overlappedBy": (-1, 3)}
    df = spark.createDataFrame([(n, *s) for n, s in spans.items()], "name string, b1 int, b2 int")
    assert all(r[0] == r[1] for r in df.select("name", reasoning.allen(F.lit(1), F.lit(4), F.col("b1"), F.col("b2"))).collect())


def test_valid(spark):
    t = spark.createDataFrame([(1, dt.date(2020, 1, 1), None), (2, None, dt.date(2019, 1, 1)), (3, None, None)], "id int, valid_from date, valid_to date")
    assert [r.id for r in reasoning.valid_at(t, F.lit(dt.date(2020, 6, 1))).orderBy("id").collect()] == [1, 3]
    assert reasoning.valid_during(t, F.lit(dt.date(2018, 1, 1)), F.lit(dt.date(2021, 1, 1))).count() == 3


def test_probability(spark):
    t = spark.createDataFrame([("s", "p", "o", 0.5, "b"), ("s", "p", "o", 0.2, "a")], "s string, p string, o string, prob double, source string")
    got = {m: reasoning.aggregate_probability(t, m).first().prob for m in ("noisy_or", "max", "average", "first")}
    assert got == pytest.approx({"noisy_or": 0.6, "max": 0.5, "average": 0.35, "first": 0.2})
    made = spark.range(1).select(*[f([F.lit(0.5), F.lit(0.4)]).alias(n) for n, f in reasoning.COMBINE.items()]).first().asDict()
    assert made == pytest.approx({"product": 0.2, "minimum": 0.4, "harmonic": 2 / 4.5, "noisy_and": 0.208})
    a = spark.createDataFrame([([1], 0.6), ([1, 2], 0.4)], "hypotheses array<int>, mass double")
    b = spark.createDataFrame([([2], 0.5), ([1, 2], 0.5)], "hypotheses array<int>, mass double")
    both = reasoning.dempster_shafer(a, b)
    assert {tuple(r.hypotheses): round(r.mass, 6) for r in both.collect()} == {(1,): round(0.3 / 0.7, 6), (2,): round(0.2 / 0.7, 6), (1, 2): round(0.2 / 0.7, 6)}
    assert tuple(reasoning.belief(both, [1]).first()) == pytest.approx((0.3 / 0.7, 0.5 / 0.7))


def test_fuzzy(spark):
    df = spark.createDataFrame([("k", 0.5)], "key string, f double")
    points = reasoning.mamdani(df, "key", [(F.col("f"), "triangular", (0.0, 5.0, 10.0))], 0, 10)
    assert reasoning.defuzzify(points, "key").first().value == pytest.approx(5.0)
    assert reasoning.defuzzify(points, "key", "som").first().value == pytest.approx(2.5)
    assert reasoning.defuzzify(points, "key", "lom").first().value == pytest.approx(7.5)
    norms = spark.range(1).select(*[f(F.lit(0.7), F.lit(0.6)).alias(n) for n, f in reasoning.T_NORMS.items()]).first().asDict()
    assert norms == pytest.approx({"minimum": 0.6, "product": 0.42, "lukasiewicz": 0.3, "drastic": 0.0})


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in reasoning.most_similar(v, [1.0, 0.1], 2).collect()] == [1, 2]
    assert spark.range(1).select(reasoning.transe_score(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.array(F.lit(5.0)))).first()[0] == -2.0


def test_change_stream(spark, tmp_path):
    rules = rulesets.rules("{ ?x <p> ?y . ?y <p> ?z } => { ?x <p> ?z } .")
    state = Reactive(Graph.of(spark, [("<a>", "<p>", "<b>")]), rules, retract=True)
    seen = []
    state.subscribe(("<a>", "<p>", "?x"), lambda df: seen.extend(r.x for r in df.collect()))
    folder = str(tmp_path / "changes")
    spark.createDataFrame([("add", "<b>", "<p>", "<c>", 1), ("add", "<c>", "<p>", "<d>", 2), ("remove", "<c>", "<p>", "<d>", 3)], CHANGES).coalesce(1).write.json(folder)
    stream = spark.readStream.schema(CHANGES).json(folder)
    state.start(stream, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(state.graph.triples) == [("<a>", "<p>", "<b>"), ("<a>", "<p>", "<c>"), ("<b>", "<p>", "<c>")] and seen == ["<c>"]
    state.apply(spark.createDataFrame([("remove", "<b>", "<p>", "<c>", 4)], CHANGES))
    assert rows(state.graph.triples) == [("<a>", "<p>", "<b>")]


def test_worlds(spark):
    rules = rulesets.rules("{ ?x <rain> <yes> } => { ?x <wet> <yes> } . { ?x <hose> <yes> } => { ?x <wet> <yes> } .")
    g = Graph.of(spark, [("<lawn>", "<in>", "<garden>")])
    wet = ("<lawn>", "<wet>", "<yes>")
    rain, hose = ("<lawn>", "<rain>", "<yes>"), ("<lawn>", "<hose>", "<yes>")
    assert wet in rows(worlds.what_if(g, rules, [rain]))
    assert worlds.abduce(g, rules, wet, [rain, hose]) == [(rain,), (hose,)]
    a, b = (g.insert(spark.createDataFrame([t], TRIPLE)) for t in (rain, hose))
    assert rows(worlds.necessarily([a, b])) == [("<lawn>", "<in>", "<garden>")] and worlds.possibly([a, b]).count() == 3
    assert {r.world for r in worlds.compare(a, b).collect()} == {"a", "b", "both"}


def test_argumentation():
    f = worlds.Framework("abc", [("a", "b"), ("b", "c")])
    assert f.grounded() == {"a", "c"} and f.stable() == [{"a", "c"}]
    either = worlds.Framework("ab", [("a", "b"), ("b", "a")])
    assert either.grounded() == set() and either.skeptical() == set() and either.credulous() == {"a", "b"}


def test_constraints():
    queens = [((x, y), lambda u, v, d=j - i: u != v and abs(u - v) != d) for i, x in enumerate("abcdef") for j, y in enumerate("abcdef") if i < j]
    assert len(worlds.solve({q: list(range(6)) for q in "abcdef"}, queens)) == 4
    assert worlds.optimise({"x": [1, 2, 3], "y": [1, 2, 3]}, [(("x", "y"), lambda x, y: x + y < 5)], lambda s: s["x"] * s["y"])[1] == 4
    assert worlds.solve({"x": [1]}, [(("x",), lambda x: x > 1)]) == []


def test_provers(spark):
    c = frozenset
    assert provers.refute([c([(True, "man", "socrates")]), c([(False, "man", "X"), (True, "mortal", "X")])], [c([(False, "mortal", "socrates")])]) == "unsatisfiable"
    assert provers.refute([c([(True, "p", "X")]), c([(False, "q", "a")])]) == "saturated"
    assert provers.unify(("f", "X", "b"), ("f", "a", "Y")) == {"X": "a", "Y": "b"} and provers.unify("X", ("f", "X")) is None
    assert provers.satisfy([[1, 2], [-1, 2], [1, -2], [-1, -2]]) is None and provers.satisfy([[1], [-1, 2]]) == {1: True, 2: True}
    atom = lambda p, *a: ("atom", p, *a)
    assert provers.valid(("implies", ("exists", "Y", ("forall", "X", atom("r", "X", "Y"))), ("forall", "X", ("exists", "Y", atom("r", "X", "Y")))))
    assert provers.tableau(("implies", ("forall", "X", atom("p", "X")), atom("p", "a"))) and not provers.tableau(atom("p"))
    group = provers.complete([(("m", "e", "X"), "X"), (("m", ("i", "X"), "X"), "e")])
    assert group is not None and provers.rewrite(("m", "e", ("m", ("i", "a"), "a")), group) == "e"
    assert not provers.congruence([("a", "b")], [(("f", "a"), ("f", "b"))])
    problems = spark.createDataFrame([(1, "p cnf 1 2\n1 0\n-1 0"), (2, "p cnf 1 1\n1 0"), (3, None)], "id long, dimacs string")
    assert rows(provers.solve_many(problems).where("id < 3")) == [(1, False), (2, True)]


def test_cache_and_limits(spark):
    now = [0.0]
    kept = cache.QueryCache(size=1, ttl=10, clock=lambda: now[0])
    make = lambda: spark.range(3)
    kept.get("SELECT  *", make)
    kept.get("SELECT *", make)
    assert (kept.hits, kept.misses) == (1, 1)
    now[0] = 11
    kept.get("SELECT *", make)
    assert kept.misses == 2
    kept.clear()
    limit = cache.RateLimiter(1, 2, clock=lambda: now[0])
    assert [limit.allow() for _ in range(3)] == [True, True, False]


def test_sentences():
    rule = rulesets.rules("{ ?x a <http://e/Human> } => { ?x a <http://e/Mortal> } .")[0]
    assert language.verbalise(rule) == "If x is a Human, then x is a Mortal."
    assert language.question("who knows bob?", "http://e/") == [("?x", "<http://e/knows>", "<http://e/bob>")]
