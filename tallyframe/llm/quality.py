"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a number per document that grows as the document looks worse, with a grid of cutoffs
from lenient to strict that is fixed beforehand.  Labelled documents of good quality are the holdout.
For a stratum (language) and cutoff, k of the n good holdout documents exceed the cutoff.  The
cutoff is admissible if the exact binomial test rejects "it loses more than ``risk`` of the good
documents", that is P(Bin(n, risk) <= k) <= level, which is the Clopper-Pearson upper bound at
confidence 1 - level lying at or under ``risk``.  Cutoffs of a rule are tested in order, from lenient
to strict, up to the first that fails, which needs no correction; over the rules and strata the
level is divided (Bonferroni): level = ``delta`` / (rules x strata).  So with probability 1 - delta no
selected cutoff, in any stratum, loses more than ``risk`` of that stratum's good documents.  A rule
without an admissible cutoff is off in its stratum; so is every rule in a stratum without labels.

Defined cases: a null text has no words.  A null language is a stratum of its own.  Null labels are
ignored; a document labelled more than once is good if any label says so.  Every row is judged on
its own text, so repeated rows come out as often as they come in.  Empty documents or labels are
fine.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE, aside, with_row, written

#: Largest share of good documents that one rule may lose, and the chance that any does lose more.
RISK = 0.01
DELTA = 0.05
#: Up to so many strata go to every executor (one short row each).
STRATA = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

#: Rules: SQL over the base columns, and cutoffs from lenient to strict; a document fails above it.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)),
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (2.0, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0)),
    "few_words": ("-n_words", (-5.0, -10.0, -15.0, -20.0, -30.0, -40.0, -50.0)),
}


def measured(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``also`` and the base measures of every whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    symbols = t
    for c in "#*$%&|<>":
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    one = docs.select(*[F.col(c) for c in also], words.alias("w"), lines.alias("l"),
                      (F.length(t) - F.length(symbols)).cast("long").alias("n_symbols"))
    n = F.size("w")
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    two = one.select(*also, "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                     F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), hashed.alias("h"))
    size = F.size("h")
    window = F.when(size >= 5, F.transform(F.sequence(F.lit(0), size - 5), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)])))
    three = two.select(*also, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", window.alias("win"))
    some = F.coalesce(F.size(F.array_distinct("win")) < F.size("win"), F.lit(False))
    # windows with their places, sorted: a window found twice has an equal neighbour
    placed = F.when(some, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    four = three.select(*also, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", placed.alias("p"))
    twice = F.expr("filter(p, (s, i) -> get(p, i - 1).x <=> s.x or get(p, i + 1).x <=> s.x)")
    five = four.select(*also, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", F.sort_array(F.transform(twice, lambda s: s["i"])).alias("at"))
    covered = F.expr("coalesce(aggregate(transform(at, (a, i) -> least(5, coalesce(get(at, i + 1) - a, 5))), 0L, (s, k) -> s + k), 0L)")
    six = five.select(*also, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    return six.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _binomial_cdf(k: str, n: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k is above the mean."""
    start = f"named_struct('t', {n} * ln(1D - {p!r}D), 's', exp({n} * ln(1D - {p!r}D)))"
    step = (f"named_struct('t', a.t + ln(({n} - i + 1D) / i * {p / (1 - p)!r}D), "
            f"'s', a.s + exp(a.t + ln(({n} - i + 1D) / i * {p / (1 - p)!r}D)))")
    terms = f"if({k} < 1, array(), sequence(1L, {k}))"
    return f"if({k} > {n} * {p!r}D, 1D, aggregate(cast({terms} as array<bigint>), {start}, (a, i) -> {step}, a -> a.s))"


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, int]:
    """One row per stratum with labelled good documents: ``stratum, n_good``, a cutoff (or null) per rule; and their number.

    ``measures`` has ``doc_id, stratum`` and the base measures, ``labels`` has ``doc_id, quality``.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measures.join(good, "doc_id", "left_semi")
    counts = []
    for name, (value, cutoffs) in RULES.items():
        counts.append(F.array(*[F.count_if(F.expr(f"{value} > {c!r}D")) for c in cutoffs]).alias(f"k_{name}"))
    counted = written(held.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts), "quality-counts")
    strata = counted.count()
    level = delta / (len(RULES) * max(1, strata))
    chosen = []
    for name, (_, cutoffs) in RULES.items():
        grid = ", ".join(f"{c!r}D" for c in cutoffs)
        test = _binomial_cdf("x.k", "n_good", risk)
        tests = f"transform(k_{name}, (k, i) -> named_struct('k', k, 'c', get(array({grid}), i)))"
        chosen.append(F.expr(
            f"aggregate({tests}, named_struct('open', true, 'best', cast(null as double)), "
            f"(a, x) -> if(a.open and {test} <= {level!r}D, named_struct('open', true, 'best', x.c), "
            f"named_struct('open', false, 'best', a.best)), a -> a.best)").alias(name))
    return counted.select("stratum", "n_good", *chosen), strata


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "lang",
           also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``also``, the base measures, ``kept``, and ``failed``, the names of the rules a document breaks."""
    src = docs.select(*[F.col(c) for c in dict.fromkeys((*also, "doc_id"))], F.col(stratum).cast("string").alias("stratum"), "text")
    names = tuple(dict.fromkeys((*also, "doc_id", "stratum")))
    measures = written(measured(src, also=names), "quality")
    found, strata = thresholds(measures, labels, risk, delta)
    found = written(found, "quality-cutoffs")
    rules = F.broadcast(found) if strata <= STRATA else found
    rules = rules.select(F.col("stratum").alias("of"), *[F.col(r).alias(f"c_{r}") for r in RULES])
    both = measures.join(rules, measures["stratum"].eqNullSafe(rules["of"]), "left")
    broken = F.array_compact(F.array(*[F.when(F.expr(f"{v} > c_{r}"), F.lit(r)) for r, (v, _) in RULES.items()]))
    out = both.withColumn("failed", F.when(F.col("base_failed"), F.array_append(broken, F.lit("base"))).otherwise(broken))
    return out.select(*also, *BASE, (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    plain, back = aside(docs)
    numbered = with_row(plain)
    good = judged(numbered, labels, also=(ROW,), **options).where("kept").select(ROW)
    return numbered.join(good, ROW, "left_semi").drop(ROW).withColumnsRenamed(back)


def _oracle(risk: float = RISK, delta: float = DELTA) -> str:
    """DuckDB SQL for :func:`judged` over ``documents`` and ``labels``, with lgamma for the binomial terms."""
    cuts = ", ".join(f"('{r}', {i}, {c!r}::DOUBLE)" for r, (_, cs) in RULES.items() for i, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v}" for r, (v, _) in RULES.items()) + " END"
    term = (f"exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({risk!r}::DOUBLE) "
            f"+ (n_good - i) * ln(1 - {risk!r}::DOUBLE))")
    broken = ", ".join(f"CASE WHEN {v} > (SELECT cutoff FROM chosen c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM m.lang) "
                       f"THEN '{r}' END" for r, (v, _) in RULES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[{SPACE}]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM d),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM parts, range(1, len(w) - 3) AS q(i)),
again AS (
  SELECT r, unnest(range(i, i + 5)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) x WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT place) AS n FROM again GROUP BY r),
m AS (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM parts LEFT JOIN repeats USING (r)),
held AS (SELECT * FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
strata AS (SELECT lang AS stratum, count(*) AS n_good FROM held GROUP BY lang),
cuts AS (SELECT * FROM (VALUES {cuts}) AS c(rule, step, cutoff)),
counted AS (
  SELECT s.stratum, n_good, rule, step, cutoff, count(*) FILTER (WHERE {value} > cutoff) AS k
  FROM cuts, strata s JOIN held h ON h.lang IS NOT DISTINCT FROM s.stratum GROUP BY ALL),
tested AS (
  SELECT *, k <= n_good * {risk!r} AND (SELECT sum({term}) FROM range(0, k + 1) AS q(i))
    <= {delta!r} / ({len(RULES)} * (SELECT count(*) FROM strata)) AS ok FROM counted),
chosen AS (
  SELECT stratum, rule, max_by(cutoff, step) AS cutoff FROM tested t
  WHERE NOT EXISTS (SELECT 1 FROM tested x WHERE x.rule = t.rule AND x.stratum IS NOT DISTINCT FROM t.stratum AND x.step <= t.step AND NOT x.ok)
  GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' AS kept, failed
FROM (SELECT *, array_to_string(list_filter([{broken}, CASE WHEN base_failed THEN 'base' END], lambda x: x IS NOT NULL), ',') AS failed FROM m) x
"""


ORACLE = _oracle()
