"""Quality filtering by weak supervision, in DataFrame and SQL functions alone.

Rules vote good (+1), bad (-1) or abstain (0) on each document. Expectation-maximisation over the counts of vote
patterns estimates, without labels, how far each rule's votes and silence can be trusted and the share of good
documents; the verdict is the posterior probability of good, not the conjunction of all rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Rounds of expectation-maximisation; first guesses of the good share and of a rule's votes (-1, 0, +1) on good and on
#: bad documents, and the documents the guesses count as.
ROUNDS, FIRST_PRIOR, GOOD_VOTES, BAD_VOTES, PSEUDO = 25, 0.8, (0.004, 0.896, 0.1), (0.3, 0.64, 0.06), 10.0


def _over(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts the rules vote by, one row for each row of docs.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_letters, n_upper, n_stops;
    all 0 for a null or empty text.
    """
    word = r"'[\\x20\\x09-\\x0D]+'"
    base = docs.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    split = base.withColumn("__words", F.expr(f"array_remove(split(__text, {word}, -1), '')"))
    split = split.withColumn("__n", F.size("__words"))
    # bits that hold any place in the text; a longer text takes more of them from the hash
    split = split.withColumn("__bits", F.expr("cast(ceil(log2(__n + 2)) as int)")).withColumn("__step", F.expr("shiftleft(1L, __bits)"))
    split = split.withColumn("__keys", F.expr("""
        case when __n < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, __n - 3), i ->
            shiftleft(shiftright(xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)), __bits), __bits) + i)) end"""))
    same = "get(__words, cast(pmod(x, __step) as int) + {k}) = get(__words, cast(pmod(get(__keys, i {d} 1), __step) as int) + {k})"
    beside = lambda d: f"case when shiftright(x, __bits) = shiftright(get(__keys, i {d} 1), __bits) then " + " and ".join(same.format(k=k, d=d) for k in range(3)) + " else false end"
    split = split.withColumn("__again", F.expr(f"transform(filter(__keys, (x, i) -> {beside('-')} or {beside('+')}), x -> pmod(x, __step))"))
    lines = split.withColumn("__lines", F.expr(r"filter(split(__text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    return lines.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__n").cast("bigint").alias("n_words"),
        F.expr("cast(length(array_join(__words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(__text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(__lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(__again, p -> array(p, p + 1, p + 2))))) as bigint)").alias("n_repeat_words"),
        F.expr("cast(size(array_distinct(__words)) as bigint)").alias("n_distinct"),
        F.expr(r"cast(length(regexp_replace(__text, '[^\\p{L}]+', '')) as bigint)").alias("n_letters"),
        F.expr(r"cast(length(regexp_replace(__text, '[^\\p{Lu}]+', '')) as bigint)").alias("n_upper"),
        F.expr("cast(regexp_count(__text, '[.!?]') as bigint)").alias("n_stops"),
    )


def votes() -> Column:
    """Each rule's vote on a row of ``features``, as an array."""
    n = F.col("n_words")

    def rule(good: Column, bad: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    length = _over(F.col("word_chars"), n)
    symbols = _over(F.col("n_symbols"), n)
    dup = _over(F.col("n_dup_lines"), F.col("n_lines"))
    repeat = _over(F.col("n_repeat_words"), n)
    distinct = _over(F.col("n_distinct"), n)
    letters = _over(F.col("n_letters"), F.col("word_chars"))
    upper = _over(F.col("n_upper"), F.col("n_letters"))
    stops = _over(F.col("n_stops"), n)
    never = F.lit(False)
    return F.array(
        rule(never, (length < 2) | (length > 14)),
        rule(never, symbols > 0.2),
        rule(never, dup > 0.3),
        rule(never, repeat > 0.3),
        rule(never, (n >= 50) & (distinct < 0.15)),
        rule(never, letters < 0.7),
        rule(never, upper > 0.5),
        rule((stops >= 0.02) & (stops <= 0.4), (n >= 100) & (stops < 0.002)),
    )


def fit(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, ratios) that expectation-maximisation finds for the votes in column ``votes``.

    ratios holds, for each rule and each of its votes -1, 0, +1, the log ratio of the vote's probability in good and in
    bad documents: how far the rule is right, silence included. The documents come in as counts of vote patterns, of
    which rules with three outcomes have a bounded number (3 to the number of rules), whatever the input. First guesses
    count as PSEUDO documents, and a vote never counts against its meaning. Without documents the guesses stay.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    listed = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"), F.coalesce(F.max(F.size("votes")), F.lit(0)).alias("k"))
    posterior = (
        "transform(patterns, p -> named_struct('v', p.votes, 'n', p.n, 'q', 1D / (1D + exp(-(ln(m.prior / (1D - m.prior)) + "
        "aggregate(zip_with(p.votes, m.ratios, (v, r) -> get(r, v + 1)), 0D, (s, x) -> s + x))))))"
    )

    def chance(weight: str, guess: tuple[float, ...]) -> str:
        guesses = ", ".join(f"{PSEUDO * g}D" for g in guess)
        return (
            f"(get(array({guesses}), v + 1) + aggregate(e, 0D, (s, r) -> s + case when get(r.v, j) = v then {weight} else 0D end)) "
            f"/ ({PSEUDO}D + aggregate(e, 0D, (s, r) -> s + {weight}))"
        )

    ratio = f"ln({chance('r.n * r.q', GOOD_VOTES)}) - ln({chance('r.n * (1D - r.q)', BAD_VOTES)})"
    ratios = f"transform(sequence(0, k - 1), j -> transform(array(-1, 0, 1), v -> case v when -1 then least(0D, {ratio}) when 1 then greatest(0D, {ratio}) else {ratio} end))"
    prior = (
        f"greatest(0.01D, least(0.99D, aggregate(e, named_struct('q', {PSEUDO * FIRST_PRIOR}D, 'n', {PSEUDO}D), "
        "(s, r) -> named_struct('q', s.q + r.n * r.q, 'n', s.n + r.n), s -> s.q / s.n)))"
    )
    step = f"aggregate(array({posterior}), m, (m0, e) -> named_struct('prior', {prior}, 'ratios', {ratios}))"
    guess = ", ".join(f"{math.log(g / b)!r}D" for g, b in zip(GOOD_VOTES, BAD_VOTES, strict=True))
    first = f"named_struct('prior', {FIRST_PRIOR}D, 'ratios', transform(sequence(0, k - 1), j -> array({guess})))"
    model = f"case when k = 0 then named_struct('prior', {FIRST_PRIOR}D, 'ratios', cast(array() as array<array<double>>)) else aggregate(sequence(1, {rounds}), {first}, (m, i) -> {step}) end"
    return listed.select(F.expr(model).alias("m")).select("m.prior", "m.ratios")


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, quality (posterior probability of good) and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows; such documents are not kept, others
    are where quality >= least; the model is fitted to those others. Features are written once to the shared folder, then counted and judged from there.
    A null or empty text has no words and fails. Repeated rows are judged each; an empty table gives an empty one;
    further columns of docs are not read.
    """
    found = written(features(docs, text_col, keep)).withColumn("votes", votes())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit(found.where(~failed)).first()  # what the base rules leave; a prior and three numbers for each rule
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, ratios in enumerate(model["ratios"]):
        score = score + F.get(F.array(*map(F.lit, ratios)), F.col("votes")[j] + 1)
    quality = 1 / (1 + F.exp(-score))
    return found.withColumn("base_failed", failed).withColumn("quality", quality).withColumn("kept", ~failed & (quality >= least)).drop("votes")
