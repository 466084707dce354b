"""Mixing sources to target weights by Pareto order sampling.

The mix is as large as the targets and the cap on repeats allow. A source that must give more than it has is copied
whole as often as needed; for the rest each document has an inclusion probability that grows with the root of its size
(1 at most: such documents are certain), and the documents with the smallest ratio of random odds to inclusion odds are
taken until the size is reached. The cut is found on histograms of the ratio, each over the bin that crosses the size in the
one before, until single documents are told apart; so no source is ever sorted or gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE_POWER = 0.5
SIZE_BINS = 1.02  # ratio of neighbouring size bins
CUT_BINS = 1000
LEVELS = 5  # histograms at most: CUT_BINS ** LEVELS bins are as fine as the ratio itself


def solve_rate(bins: list[tuple[float, float]], need: float) -> float:
    """lam such that sum(min(1, lam * x ** SIZE_POWER) * tokens) over (x, tokens) is need."""
    lo, hi = 0.0, 1.0 / min(x for x, _ in bins) ** SIZE_POWER
    for _ in range(80):
        lam = (lo + hi) / 2
        if sum(min(1.0, lam * x**SIZE_POWER) * t for x, t in bins) < need:
            lo = lam
        else:
            hi = lam
    return hi


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    return (F.pmod(F.xxhash64(*columns), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def mixed(docs: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row per mix and document used: mix_name, source, key, n_tokens, copies.

    docs must be cheap to read again (a written table). Documents of NULL source or no tokens are never used. A target for a
    source without documents gives nothing, and the other shares of its mix are reckoned without it. targets is a dimension
    whose rows are read on the driver.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(size) > 0).select(key, "source", F.col(size).alias("n_tokens"))
    bin_no = F.floor(F.log(F.col("n_tokens").cast("double")) / math.log(SIZE_BINS))
    by_bin = docs.groupBy("source", bin_no.alias("b")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()  # a few hundred bins a source
    have: dict[str, list[tuple[float, float]]] = {}
    for r in by_bin:
        if r.source is not None:
            have.setdefault(r.source, []).append((r.tokens / r.n, float(r.tokens)))
    mixes: dict[str, list] = {}
    for r in targets.collect():
        mixes.setdefault(r.mix_name, []).append(r)
    plan = []
    for mix, rows in mixes.items():
        rows = [r for r in rows if r.target_share > 0 and r.source in have]
        whole_share = sum(r.target_share for r in rows)
        total = {r.source: sum(t for _, t in have.get(r.source, [])) for r in rows}
        reach = min((total[r.source] * r.max_repeats * whole_share / r.target_share for r in rows), default=0.0)
        for r in rows:
            need = reach * r.target_share / whole_share
            if need > 0:
                whole = min(int(need / total[r.source] + 1e-9), r.max_repeats)
                rest = max(0.0, need - whole * total[r.source])
                rate = solve_rate(have[r.source], rest) if rest >= 1 else 0.0
                plan.append((mix, r.source, whole, rest, rate))
    schema = "mix_name string, source string, whole int, rest double, rate double"
    p = spark.createDataFrame(plan, schema)  # as many rows as targets
    prob = F.least(F.lit(1.0), F.col("rate") * F.pow(F.col("n_tokens").cast("double"), F.lit(SIZE_POWER)))
    u = uniform(F.col("mix_name"), F.col(key))
    ratio = (u / (1 - u)) / (F.col("prob") / (1 - F.col("prob")))
    ranked = docs.join(F.broadcast(p), "source").withColumn("prob", prob)
    ranked = ranked.withColumn("v", F.when(F.col("rate") <= 0, 1.0).when(F.col("prob") >= 1, 0.0).otherwise(ratio / (1 + ratio)))
    level = {(m, s): (0.0, rest) for m, s, _, rest, rate in plan if rate > 0}  # lower end of the bin that crosses, what it must still give
    cuts: dict[tuple[str, str], float] = {}  # documents below are taken
    width = 1.0
    for n in range(LEVELS):
        if not level:
            break
        edges = spark.createDataFrame([(m, s, lo) for (m, s), (lo, _) in level.items()], "mix_name string, source string, lo double")
        inside = ranked.where("rate > 0").join(F.broadcast(edges), ["mix_name", "source"]).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + width))
        bins = inside.groupBy("mix_name", "source", F.floor((F.col("v") - F.col("lo")) / (width / CUT_BINS)).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # CUT_BINS rows a source at most
        width /= CUT_BINS
        following = {}
        for k, (lo, rest) in level.items():
            before, cuts[k] = 0, lo + width * CUT_BINS
            for b, t, n_docs in sorted((r.b, r.t, r.n) for r in bins if (r.mix_name, r.source) == k):
                if before + t > rest:
                    if n_docs > 1 and n + 1 < LEVELS:
                        following[k] = (lo + b * width, rest - before)
                    # the last document is taken where that comes closer
                    cuts[k] = lo + (b + (before + t - rest < rest - before)) * width
                    break
                before += t
        level = following
    both = spark.createDataFrame([(m, s, c) for (m, s), c in cuts.items()], "mix_name string, source string, cut double")
    chosen = ranked.join(F.broadcast(both), ["mix_name", "source"], "left").withColumn("extra", F.when(F.col("v") < F.col("cut"), 1).otherwise(0))
    return chosen.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).where("copies > 0").select("mix_name", "source", key, "n_tokens", "copies")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source the target share, the share reached, and the largest number of copies."""
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    out = targets.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    return out.select("mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
