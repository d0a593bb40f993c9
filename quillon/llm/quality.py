"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base figures and the base rule are fixed. Beyond them, rules of the form "figure > cutoff" are chosen per stratum
(language) from labelled rows. What is guaranteed is that, with probability 1 - `delta`, the rules of no stratum together
falsely reject more than `alpha` of its good documents (those labelled of high quality and not toxic).

Cutoffs are tightened step by step in a fixed order, from the loosest on, the figures in turn. Each step is the joint
rule of all cutoffs so far, and is taken if the exact binomial test rejects that it falsely rejects more than `alpha`. A
figure whose step fails keeps the cutoff that it has, and the others go on. Tests in a fixed order need no correction
among each other, as long as none has failed: these are made at half of the stratum's share of `delta`. After j failures
any of the C(steps, j) ways to fail may have led to the tests that follow, so the other half is split over the possible
numbers of failures and each part over these ways. The strata share `delta` evenly (Bonferroni).

A stratum whose holdout is too small to show anything gets no rule, and its documents are judged by the base rule alone.
Counting needs strata x (cutoffs + 1) of each figure cells at most, whatever the input; strata are decided one at a time.

Null text has no words (it fails the base rule); a null language is a stratum of its own. Repeated rows get repeated
results; labels that repeat for a document count once (the least favourable). Without labels there are no rules. Empty
tables give no rows. Other columns pass through figures(), but for those named like a figure, which it replaces.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialize, small_table

#: A document fails with fewer words, or with a larger percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: False rejection of good documents in a stratum, and the chance that the guarantee is wrong.
ALPHA, DELTA = 0.02, 0.05
#: Figure -> cutoffs of its rule "figure > cutoff".
GRID = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "dup_line_rate": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_rate": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "mean_word": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
WORDS = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more (64-bit hashes of windows are compared)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(windows)


def figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    name = {n: fresh(df, f"_{n}") for n in ("words", "lines", "windows", "same", "sorted", "at")}
    out = df.withColumn(name["words"], words).withColumn(name["lines"], lines)
    out = out.withColumn("n_words", F.size(name["words"]).cast("long")).withColumn(name["windows"], repeated_words(F.col(name["words"])))
    out = out.withColumn("word_chars", F.length(F.regexp_replace(text, BLANK, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(name["lines"]) - F.size(F.array_distinct(name["lines"]))).cast("long"))
    same = F.col(name["same"])
    out = out.withColumn(name["same"], F.size(F.array_distinct(name["windows"])) < F.size(name["windows"]))
    out = out.withColumn(name["sorted"], F.when(same, F.sort_array(F.transform(name["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(name["sorted"])
    twice = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | (F.get(s, k + 1)["h"] == F.get(s, k)["h"]), F.get(s, k)["i"])), lambda i: i.isNotNull())
    out = out.withColumn(name["at"], F.when(same, F.sort_array(twice)))
    p = F.col(name["at"])
    span = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.when(same, span).otherwise(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*name.values())


def rates() -> dict[str, Column]:
    """The figures that rules look at, from the base figures; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_rate": share("n_symbols", "word_chars"), "dup_line_rate": share("n_dup_lines", "n_words"), "repeat_rate": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def steps(grid: dict[str, list[float]]) -> list[tuple[str, int]]:
    """(figure, index of its cutoff) in the order of the tests: from the loosest on, the figures in turn."""
    return [(f, len(c) - 1 - t) for t in range(max(map(len, grid.values()))) for f, c in grid.items() if t < len(c)]


def levels(grid: dict[str, list[float]], delta: float, strata: int) -> list[float]:
    """The level of a stratum's tests after 0, 1, ... failures; they sum up to its share of `delta` over all ways to fail."""
    m, part = len(steps(grid)), delta / (2 * max(1, strata))
    return [part, *(part / (len(grid) - 1) / math.comb(m, j) for j in range(1, len(grid)))]


def choose(cells: list[tuple], grid: dict[str, list[float]], alpha: float, level: list[float]) -> dict[str, float]:
    """figure -> cutoff for one stratum; cells: (documents, for each figure how many of its cutoffs they exceed)."""
    n, figures = sum(c[0] for c in cells), list(grid)
    at = {f: len(c) for f, c in grid.items()}  # beyond the last cutoff: no rule
    failed: set[str] = set()
    for f, j in steps(grid):
        if f in failed:
            continue
        trial = at | {f: j}
        wrong = sum(k for k, *over in cells if any(x > trial[g] for g, x in zip(figures, over)))
        if binomial_cdf(wrong, n, alpha) <= level[len(failed)]:
            at = trial
        else:
            failed.add(f)
            if len(failed) == len(level):
                break
    return {f: grid[f][j] for f, j in at.items() if j < len(grid[f])}


def rules(measured: DataFrame, labels: DataFrame, stratum: str = "lang", grid: dict[str, list[float]] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> dict[object, dict[str, float]]:
    """stratum -> figure -> cutoff from labelled documents that the base rule keeps; `measured` has doc_id, the stratum and the base figures.

    Only strata with enough labels to show anything are tested.
    """
    grid, by = grid or GRID, rates()
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).filter("_q = 1 and coalesce(_t, 0) = 0").select(F.col("doc_id").alias("_id"))
    held = measured.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    over = [sum(((by[f] > c).cast("int") for c in cutoffs), F.lit(0)).alias(f"_{i}") for i, (f, cutoffs) in enumerate(grid.items())]
    cells = held.select(F.col(stratum).alias("_s"), *over).groupBy("_s", *[f"_{i}" for i in range(len(grid))]).agg(F.count(F.lit(1)).alias("_n"))
    least = math.ceil(math.log(delta / 2) / math.log1p(-alpha))
    cells = materialize(cells.withColumn("_all", F.sum("_n").over(Window.partitionBy("_s"))).filter(F.col("_all") >= least), "cells")
    level = levels(grid, delta, cells.select("_s").distinct().count())
    rows = cells.select("_s", "_n", *[f"_{i}" for i in range(len(grid))]).orderBy("_s").toLocalIterator()  # one stratum at a time
    found = {s: choose([tuple(r[1:]) for r in part], grid, alpha, level) for s, part in itertools.groupby(rows, key=lambda r: r[0])}
    return {s: c for s, c in found.items() if c}


def judged(measured: DataFrame, cutoffs: dict[object, dict[str, float]], out: str = "kept", stratum: str = "lang") -> DataFrame:
    """`measured` with `out`: false if the base rule or a rule of the document's stratum rejects it. The rules are a row a stratum."""
    by, s = rates(), fresh(measured, "_stratum")
    limits = {f: fresh(measured, f"_most_{f}") for f in by}
    kind = measured.schema[stratum].dataType.simpleString()
    table = small_table(measured.sparkSession, [(k, *[c.get(f) for f in by]) for k, c in cutoffs.items()], [(s, kind), *((x, "double") for x in limits.values())])
    within = [F.coalesce(by[f] <= F.col(x), F.lit(True)) for f, x in limits.items()]
    both = measured.join(table, measured[stratum].eqNullSafe(F.col(s)), "left")
    kept = ~F.col("base_failed")
    for w in within:
        kept = kept & w
    return both.withColumn(out, kept).drop(s, *limits.values())
