"""Steps that must not gather in one task, grow with the square of a group or read what they don't need."""

import base64
import hashlib
import hmac
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import builtins, terms
from graphloom.operators import reasoning
from graphloom.plans import compile as compiling
from graphloom.plans.expressions import Val, constant
from graphloom.queries import QUERIES, _tpch
from graphloom.sources.graphs import Graph

DATA = "/root/testdata/sf0.001"
OWL = f"<{terms.OWL}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unforced(spark):
    """Spark broadcasts nothing by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield
    spark.conf.unset(key)


def test_no_predicate_gathers_in_one_task(spark, unforced):
    facts = [(f"<s{i}>", "<p>", f"<o{i % 3}>") for i in range(6)] + [("<s1>", "<p>", "<o2>"), ("<p>", terms.TYPE, f"{OWL}FunctionalProperty>"), ("<p>", terms.TYPE, f"{OWL}InverseFunctionalProperty>")]
    g = Graph.of(spark, facts)
    for inverse, expected in ((False, ["<s1>"]), (True, ["<o0>", "<o1>", "<o2>"])):
        found = reasoning.functional(g, inverse)
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert [r[1] for r in rows(found)] == expected


def test_no_predicate_gathers_entity_types(spark, unforced):
    g = Graph.of(spark, [(f"<s{i}>", "<p>", "<o>") for i in range(4)] + [(f"<s{i}>", terms.TYPE, f"<c{i % 2}>") for i in range(3)])
    found = reasoning.entity_types(g)
    assert plan(found).count("BroadcastHashJoin") == 1
    assert rows(found) == sorted((f"<s{i}>", f"<c{k}>", 1.0 if i < 3 and i % 2 == k else (0.5, 0.25)[k]) for i in range(4) for k in range(2))


def test_predicate_pairs_count_subjects_by_bits(spark, monkeypatch):
    own = {f"<s{i}>": [f"<p{k}>" for k in range(140) if (i * 31 + k * 17) % 9 < 3] for i in range(12)}
    g = Graph.of(spark, [(s, p, f"<o{k}>") for s, ps in own.items() for p in ps for k in range(2)])
    expected = {}
    for ps in own.values():
        for pair in permutations(ps, 2):
            expected[pair] = expected.get(pair, 0) + 1
    n = {p: sum(p in ps for ps in own.values()) for p in {x for ps in own.values() for x in ps}}
    found = reasoning.predicate_pairs(g)
    assert rows(found) == sorted((a, b, k, k / n[a]) for (a, b), k in expected.items())
    assert "[s#" not in "".join(x for x in plan(found).splitlines() if "Join" in x)
    monkeypatch.setattr(reasoning, "MOST_PREDICATES", 100)
    assert rows(reasoning.predicate_pairs(g)) == rows(found)


def test_statistics_of_tables_are_those_of_their_triples(spark):
    g = _tpch(spark, DATA)
    found = reasoning.statistics(g)
    assert rows(found) == rows(reasoning.statistics(Graph(g.triples))) and found.columns == ["triples", "subjects", "predicates", "objects"]
    assert "Expand" not in plan(found)


def test_nearest_holds_a_bounded_number_of_similarities(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = rows(reasoning.nearest(v, v.where("vec_id % 3 = 0"), 5))
    monkeypatch.setattr(reasoning, "MOST_ALIKE", 130)
    assert rows(reasoning.nearest(v, v.where("vec_id % 3 = 0"), 5)) == whole and len(whole) == 100


def test_optional_step_reads_what_its_subjects_need(spark):
    found = QUERIES["path_opt"](spark, DATA)
    assert {f.rsplit("/", 1)[-1] for f in found.inputFiles()} == {"customer.parquet"}
    assert len(rows(found)) == 300


def test_signing_with_a_written_key_prepares_it_once(spark):
    sign = f"<{builtins.NAMESPACES['crypto']}sign>"
    for key in ("key", 'k"\\\n', "long" * 30):
        literal = builtins.evaluate(sign, [Val(_text=F.col("t")), constant(terms.literal(key))], None).text
        read = builtins.evaluate(sign, [Val(_text=F.col("t")), Val(_text=F.col("k"))], None).text
        df = spark.createDataFrame([("some text", key), ("", key)], "t string, k string")
        expected = sorted((base64.b64encode(hmac.new(key.encode(), t.encode(), hashlib.sha256).digest()).decode(),) * 2 for t in ("some text", ""))
        assert rows(df.select(literal.alias("a"), read.alias("b"))) == expected
        assert "transform(" not in plan(df.select(literal))


def test_products_are_dealt_to_all_partitions(spark):
    from graphloom.plans.compile import Solutions

    left = Solutions(spark.range(300).selectExpr("cast(id as string) a"), ["a"])
    right = Solutions(spark.range(500).selectExpr("cast(id as string) b"), ["b"])
    out = compiling._product(left, right).frame
    sizes = out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 150_000 and len(sizes) >= 4 and max(sizes) < 75_000
    assert out.distinct().count() == 150_000


def test_values_of_terms(spark):
    given = ['""', '"a"', '"a\\"b"', '"a"@en', '"1"^^<t>', "<>", "<a>", "_:b", '"', "<", "plain", '"a\nb"', '"\\\\n"']
    found = [r[0] for r in spark.createDataFrame([(x,) for x in given], "t string").coalesce(1).select(terms.value(F.col("t"))).collect()]
    assert found == ["", "a", 'a"b', "a", "1", "", "a", "b", '"', "<", "plain", "a\nb", "\\n"]
