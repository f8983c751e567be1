"""Statistics of runs by arm: pass rates, intervals, paired tests, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knowledge import median_of
from .prefix import running


def by_arm(runs: DataFrame) -> DataFrame:
    """(arm, n, pass_at_one, cycles_median, convergence) from (arm, target, seed, passed, cycles)."""
    out = runs.groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_at_one"),
        F.avg((F.col("passed") & F.col("cycles").isNotNull()).cast("double")).alias("convergence"))
    return out.join(median_of(runs.where("passed"), ["arm"], "cycles", "cycles_median"), "arm", "left").select("arm", "n",
        "pass_at_one", "cycles_median", "convergence")


def bootstrap(runs: DataFrame, resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(arm, low, high): quantiles of resampled pass rates. A resample of a boolean mean is a binomial draw over its count,
    so only two counts an arm are needed; no outcomes give 0 to 0."""

    def draw(pdf_iter):
        import zlib

        import numpy as np

        for pdf in pdf_iter:
            low, high = [], []
            for arm, n, k in zip(pdf["arm"], pdf["n"], pdf["k"]):
                means = np.random.default_rng([seed, zlib.crc32(str(arm).encode())]).binomial(n, k / n, resamples) / n if n else np.zeros(1)
                low.append(float(np.quantile(means, (1 - level) / 2)))
                high.append(float(np.quantile(means, 1 - (1 - level) / 2)))
            yield pdf.assign(low=low, high=high)[["arm", "low", "high"]].astype({"arm": object})

    counts = runs.groupBy("arm").agg(F.count("passed").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("k"))
    return counts.mapInPandas(draw, "arm string, low double, high double")


def poisson_bounds(bits: int = 32) -> list[int]:
    """Draws of so many bits from which on a Poisson weight of mean one is 1, 2, and so on."""
    total, term, out, k = math.exp(-1), math.exp(-1), [], 0
    while total < 1 and len(out) < 12:
        out.append(int(total * 2**bits))
        k += 1
        term /= k
        total += term
    return out


def resampled(rows: DataFrame, group: str, row: Column, value: Column, resamples: int = 1000) -> DataFrame:
    """(group, resample, mean): Poisson bootstrap means of any values. A row's weight in a resample is a function of the row's
    name and the resample's number, so partial sums are all that moves, and a lost task draws the same again. Empty resamples
    of small groups have no mean."""
    some = rows.select(F.col(group), value.alias("_v"), row.alias("_row")).where("_v is not null")
    dealt = some.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((resamples + 3) // 4 - 1)))).withColumn("_md5", F.md5(F.concat_ws("-",
        F.col("_row").cast("string"), F.col("_g").cast("string")).cast("binary")))
    each = dealt.select(group, "_v", "_g", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(F.col("_md5"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))).alias("_i", "_u"))
    weight = sum((F.when(F.col("_u") >= b, 1).otherwise(0) for b in poisson_bounds()), F.lit(0))
    kept = each.select(group, (F.col("_g") * 4 + F.col("_i")).alias("resample"), "_v", weight.alias("_w")).where(F.col("resample") < resamples)
    sums = kept.groupBy(group, "resample").agg(F.sum(F.col("_v") * F.col("_w")).alias("s"), F.sum("_w").alias("w"))
    return sums.where("w > 0").select(group, "resample", (F.col("s") / F.col("w")).alias("mean"))


def interval(means: DataFrame, group: str, level: float = 0.95) -> DataFrame:
    """(group, low, high): the middle part of resampled means, interpolated; a group's rows are as many as resamples."""
    ends = [(1 - level) / 2, 1 - (1 - level) / 2]
    return means.groupBy(group).agg(F.percentile("mean", F.array(*map(F.lit, ends))).alias("_x")).select(group, F.col("_x")[0].alias("low"), F.col("_x")[1].alias("high"))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k of n at one half."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(k + 1))
    return min(1.0, 2 * tail / 2**n)


def paired(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Outcomes of two arms side by side by (target, seed); a missing partner is an error."""
    rows = runs.where(F.col("arm").isin(a, b)).groupBy("target",
        "seed").agg(F.max(F.when(F.col("arm") == a, F.col("passed").cast("int"))).alias("a"),
        F.max(F.when(F.col("arm") == b, F.col("passed").cast("int"))).alias("b"),
        F.max(F.when(F.col("arm") == a, F.col("cycles"))).alias("ca"),
        F.max(F.when(F.col("arm") == b, F.col("cycles"))).alias("cb"))
    if rows.where("a is null or b is null").limit(1).count():
        raise ValueError("paired arms must have the same runs")
    return rows


def discordance(pairs: DataFrame) -> DataFrame:
    """One row: b and c, the pairs that only one side passes, n and the difference of pass rates."""
    return pairs.agg(F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)).alias("b_count"),
        F.count(F.when((F.col("a") == 0) & (F.col("b") == 1), 1)).alias("c_count"), F.count("*").alias("n"),
        F.coalesce(F.avg((F.col("a") - F.col("b")).cast("double")), F.lit(0.0)).alias("effect"))


def mcnemar(pairs: DataFrame) -> tuple[float, float]:
    """(p, effect) of the exact paired test; without disagreement (1, 0)."""
    r = discordance(pairs).first()
    n = r["b_count"] + r["c_count"]
    return (1.0, 0.0) if n == 0 else (binomial_two_sided(r["b_count"], n), r["effect"])


def rank_sums(pairs: DataFrame) -> DataFrame:
    """One row of the signed-rank test on cycles: n, plus, minus and ties (sums over sizes of difference), zero differences
    split between both sides. Ranks come from running counts by size, so neither pairs nor sizes meet in a task."""
    diffs = pairs.select((F.col("ca") - F.col("cb")).alias("d")).where("d is not null")
    counts = diffs.groupBy(F.abs("d").alias("size")).agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"),
        F.count(F.when(F.col("d") < 0, 1)).alias("down"), F.count("*").alias("n"))
    ranked = running(counts, [], ["size"], {"upto": F.col("n")})
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    zero = F.when(F.col("size") == 0, rank * F.col("n") / 2).otherwise(0.0)
    n = F.col("n").cast("double")
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("up") + zero), F.lit(0.0)).alias("plus"),
        F.coalesce(F.sum(rank * F.col("down") + zero), F.lit(0.0)).alias("minus"), F.coalesce(F.sum(n * n * n - n), F.lit(0.0)).alias("ties"),
        F.coalesce(F.sum(F.when(F.col("size") != 0, F.col("n"))), F.lit(0)).alias("moved"))


def signed_rank(pairs: DataFrame) -> float:
    """Two-sided p of the signed-rank test, by the normal approximation with a correction for ties."""
    r = rank_sums(pairs).first()
    n = r["n"]
    if not r["moved"]:
        return 1.0
    mean = n * (n + 1) / 4
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - r["ties"] / 2) / 24)
    return 1.0 if sd == 0 else math.erfc(abs((min(r["plus"], r["minus"]) - mean) / sd) / math.sqrt(2))


def lifts(summary: DataFrame, baseline: str, least: float = 0.05) -> DataFrame:
    """(arm, diff, confirmed) against a baseline, from (arm, pass_at_one, low, high): by at least `least`, intervals apart."""
    base = summary.where(F.col("arm") == baseline).select("pass_at_one", "high").first()
    diff = F.col("pass_at_one") - F.lit(base["pass_at_one"] if base else None)
    apart = F.col("low") > F.lit(base["high"] if base else None)
    return summary.where((F.col("arm") != baseline) & F.lit(base is not None)).select("arm", diff.alias("diff"), ((diff >= least) & apart).alias("confirmed"))


def additive(summary: DataFrame, both: str, parts: list[str]) -> DataFrame:
    """One row: whether an arm is at least as good as the best of its parts; false if any is missing."""
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("pass_at_one")))
    return summary.agg(F.coalesce(value(both) >= F.greatest(*[value(p) for p in parts]) if len(parts) > 1 else value(both) >= value(parts[0]),
        F.lit(False)).alias("additive"),
        F.count(F.when(F.col("arm").isin(both, *parts),
        1)).alias("_n")).select((F.col("additive") & (F.col("_n") == 1 + len(parts))).alias("additive"))
