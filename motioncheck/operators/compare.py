"""Paired comparison of two evaluations, and resampling."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT = ("scenario_id", "agent_id")
SAME = 1e-12


@dataclass(frozen=True)
class ComparisonPolicy:
    max_ade_increase_m: float = 0.0
    max_fde_increase_m: float = 0.0
    max_miss_rate_increase: float = 0.0
    max_coverage_decrease: float = 0.0
    require_significant_ade_improvement: bool = False
    require_significant_fde_improvement: bool = False

    def __post_init__(self) -> None:
        if min(self.max_ade_increase_m, self.max_fde_increase_m, self.max_miss_rate_increase, self.max_coverage_decrease) < 0:
            raise ValueError("tolerances must be nonnegative")


def policy_of(raw: dict) -> ComparisonPolicy:
    """The policy that a mapping states; other keys are ignored."""
    kinds = {f: bool if f.startswith("require_") else float for f in ComparisonPolicy.__dataclass_fields__}
    return ComparisonPolicy(**{k: kinds[k](v) for k, v in raw.items() if k in kinds})


def agent_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate minus baseline for each agent of both."""
    b = baseline.select(*AGENT, F.col("min_ade_m").alias("baseline_min_ade_m"), F.col("min_fde_m").alias("baseline_min_fde_m"), F.col("miss").alias("baseline_miss"))
    c = candidate.select(*AGENT, "object_type", F.col("min_ade_m").alias("candidate_min_ade_m"), F.col("min_fde_m").alias("candidate_min_fde_m"), F.col("miss").alias("candidate_miss"), "best_mode_index")
    both = b.join(c, list(AGENT))
    return both.select(*AGENT, "object_type", "baseline_min_ade_m", "candidate_min_ade_m", (F.col("candidate_min_ade_m") - F.col("baseline_min_ade_m")).alias("min_ade_delta_m"), (F.col("candidate_min_fde_m") - F.col("baseline_min_fde_m")).alias("min_fde_delta_m"), (F.col("candidate_miss").cast("int") - F.col("baseline_miss").cast("int")).alias("miss_delta"), F.col("best_mode_index").alias("candidate_best_mode_index"))


def identity(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Agents that only one side has: none may be compared while there are any."""
    b, c = baseline.select(*AGENT).distinct(), candidate.select(*AGENT).distinct()
    return b.join(c, list(AGENT), "left_anti").withColumn("only_in", F.lit("baseline")).union(c.join(b, list(AGENT), "left_anti").withColumn("only_in", F.lit("candidate")))


def same_agents(baseline: DataFrame, candidate: DataFrame) -> bool:
    """Whether both sides have the same agents, each as often: one aggregation, with no join and no shuffle of rows.

    The sides' sums of two 64-bit hashes are compared, which don't depend on the rows' order. identity() finds which
    agents differ; only sides that aren't the same need it.
    """
    sides = baseline.select(*AGENT, F.lit(1).alias("side")).union(candidate.select(*AGENT, F.lit(-1).alias("side")))
    text = F.to_json(F.struct(*AGENT))
    hashes = [F.xxhash64(text), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")]
    sums = [F.sum(h.cast("decimal(20,0)") * F.col("side")) for h in hashes]
    found = sides.agg(F.sum("side").alias("n"), *[x.alias(f"h{i}") for i, x in enumerate(sums)]).first()
    return not any(found)  # null where both are empty


def change_counts(deltas: DataFrame) -> DataFrame:
    """(metric, improved, unchanged, regressed)."""
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("d")) for n, c in (("min_ade_m", "min_ade_delta_m"), ("min_fde_m", "min_fde_delta_m"), ("miss", "miss_delta"))])
    each = deltas.select(F.explode(metrics).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.count_if(F.col("d") < -SAME).alias("improved"), F.count_if(F.abs("d") <= SAME).alias("unchanged"), F.count_if(F.col("d") > SAME).alias("regressed"))


def scenario_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("scenario_id").agg(F.count("*").alias("agents"), F.avg("min_ade_delta_m").alias("mean_min_ade_delta_m"), F.avg("min_fde_delta_m").alias("mean_min_fde_delta_m"), F.avg(F.col("miss_delta").cast("double")).alias("miss_rate_delta"))


def most_changed(deltas: DataFrame, regressed: bool, k: int = 10) -> DataFrame:
    by = F.desc("min_ade_delta_m") if regressed else F.asc("min_ade_delta_m")
    return deltas.orderBy(by, "scenario_id", "agent_id").limit(k)


def gate(baseline: DataFrame, candidate: DataFrame, policy: ComparisonPolicy = ComparisonPolicy()) -> DataFrame:
    """One row from two rows of means: the deltas, and whether they are within the policy's tolerances."""
    names = ("mean_min_ade_m", "mean_min_fde_m", "miss_rate", "mean_ground_truth_coverage")
    both = baseline.select(*[F.col(n).alias(f"b_{n}") for n in names]).crossJoin(F.broadcast(candidate.select(*[F.col(n).alias(f"c_{n}") for n in names])))  # one row each
    delta = {n: F.col(f"c_{n}") - F.col(f"b_{n}") for n in names}
    ok: Column = (delta["mean_min_ade_m"] <= policy.max_ade_increase_m + SAME) & (delta["mean_min_fde_m"] <= policy.max_fde_increase_m + SAME) & (delta["miss_rate"] <= policy.max_miss_rate_increase + SAME) & (-delta["mean_ground_truth_coverage"] <= policy.max_coverage_decrease + SAME)
    return both.select(*[d.alias(f"{n}_delta") for n, d in delta.items()], ok.alias("gate_passed"))


def violations(deltas: dict, intervals: dict, policy: ComparisonPolicy) -> list[str]:
    """What breaks the policy: deltas of means beyond its tolerances, or improvements that aren't significant."""
    found = [f"{name} rose by {deltas[f'{name}_delta']:g}; {most:g} is allowed" for name, most in (("mean_min_ade_m", policy.max_ade_increase_m), ("mean_min_fde_m", policy.max_fde_increase_m), ("miss_rate", policy.max_miss_rate_increase)) if deltas[f"{name}_delta"] > most + SAME]
    if -deltas["mean_ground_truth_coverage_delta"] > policy.max_coverage_decrease + SAME:
        found.append(f"mean_ground_truth_coverage fell by {-deltas['mean_ground_truth_coverage_delta']:g}; {policy.max_coverage_decrease:g} is allowed")
    for asked, name in ((policy.require_significant_ade_improvement, "min_ade_delta_m"), (policy.require_significant_fde_improvement, "min_fde_delta_m")):
        if asked and intervals[name]["upper"] >= 0:
            found.append(f"the interval of {name} reaches {intervals[name]['upper']:g}: no significant improvement")
    return found


def interval_ranks(samples: int) -> tuple[int, int]:
    """0-based ranks of a 95% interval's bounds among sorted means."""
    return math.floor(0.025 * (samples - 1)), math.ceil(0.975 * (samples - 1))


#: Words of the generator that python_draws() makes at once, at most.
WORDS = 1 << 20


def python_draws(seed: int, n: int) -> Iterator[np.ndarray]:
    """Arrays of n draws each: what random.Random(seed).randrange(n) gives, n < 2 ** 32, one call after another.

    The generator is numpy's of the same kind, from the same state. A draw is the upper bits of a word of 32
    bits, as many as n has; what is not below n is drawn again. Words left over go to the next array.
    """
    _, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    bits, left = n.bit_length(), np.empty(0, dtype=np.int64)
    while True:
        parts, held = [left], len(left)
        while held < n:
            drawn = (words.random_raw(min(WORDS, 2 * (n - held) + 64)) >> np.uint64(32 - bits)).astype(np.int64)
            parts.append(drawn[drawn < n])
            held += len(parts[-1])
        drawn = np.concatenate(parts)
        left = drawn[n:]
        yield drawn[:n]


def bootstrap_exact(values: DataFrame, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(metric, lower, upper) from values (metric, metric_ord, scenario_id, agent_id, value): Python's generator, seed + metric_ord, a task per metric.

    Values are drawn by their place in the order of scenarios and agents. Holds a metric's
    values in one task: for evaluations of up to EXACT_MOST agents; beyond, bootstrap_split().
    Draws are those of random.Random.randrange(), made from the same words a block at a time.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    low, high = interval_ranks(samples)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(list(AGENT))["value"].tolist()
        places, n = python_draws(seed + int(group["metric_ord"].iloc[0]), len(own)), len(own)
        own = np.array(own, dtype=np.float64)
        found = sorted(math.fsum(own[next(places)].tolist()) / n for _ in range(samples))
        return pd.DataFrame({"metric": [group["metric"].iloc[0]], "lower": [found[low]], "upper": [found[high]]})

    return values.groupBy("metric").applyInPandas(run, "metric string, lower double, upper double")


#: P(Poisson(1) <= k) for k = 0, 1...: a resample takes a value k times with nearly this distribution.
POISSON = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def metric_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(metric, metric_ord, scenario_id, agent_id, value): a row per column of each agent's row."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(i).alias("metric_ord"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(*AGENT, F.explode(each).alias("m")).select("m.metric", "m.metric_ord", *AGENT, "m.value")


def _bounds(means: DataFrame, samples: int) -> DataFrame:
    """(metric, lower, upper) from (metric, b, mean)."""
    low, high = interval_ranks(samples)
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.round("mean", 9), "b")) - 1)
    return ranked.groupBy("metric").agg(F.max(F.when(F.col("rank") == low, F.col("mean"))).alias("lower"), F.max(F.when(F.col("rank") == high, F.col("mean"))).alias("upper"))


def bootstrap_hashed(values: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """(metric, lower, upper) from values (metric, metric_ord, scenario_id, agent_id, value): a distributed bootstrap.

    Resample b takes a value as often as a Poisson variable of mean 1 says, which a digest of
    seed, metric, b, scenario and agent decides. So no row needs a place among all: each is read
    once, and what is shuffled is a sum for each metric, resample and task. A resample that takes
    nothing has the plain mean.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("metric_ord").cast("string"), F.col("b").cast("string"), *AGENT))
    uniform = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = values.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("u", uniform).withColumn("n", times)
    mean = F.coalesce(F.sum(F.col("n") * F.col("value")) / F.nullif(F.sum("n"), F.lit(0)), F.avg("value"))
    means = drawn.groupBy("metric", "b").agg(mean.alias("mean"))
    return _bounds(means, samples)


#: Agents whose values bootstrap_exact() holds in one task for reports; above, they take bootstrap_split().
EXACT_MOST = 100_000
#: Values in a block of bootstrap_split(), about, and blocks at most.
BLOCK, BLOCKS = 1 << 16, 1 << 16


def block_draws(sizes: np.ndarray, block: int, samples: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of each resample's draws, as many as there are values, fall into a block.

    Blocks are the leaves of a binary tree. At each node the draws are split by a binomial of its
    halves' sizes, whose generator is seeded by the key and the node: tasks that go down to
    different leaves make the same splits on the way, so the leaves' draws add up without any exchange.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    drawn = np.full(samples, before[-1], dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (before[middle] - before[low]) / max(before[high] - before[low], 1)
        left = np.random.default_rng([*key, low, high]).binomial(drawn, share)
        low, high, drawn = (low, middle, left) if block < middle else (middle, high, drawn - left)
    return drawn


def resampled_sums(values: DataFrame, samples: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(metric, b, total, n): the sum of each resample's draws from each block, and how many they are.

    A value's block is a hash of its scenario and agent, so no value needs a place among all. The
    driver reads the blocks' sizes: at most BLOCKS numbers a metric. Null values take no part.
    """
    values = values.where("value is not null")
    most = max((r["count"] for r in values.groupBy("metric").count().collect()), default=0)
    blocks = max(1, min(BLOCKS, math.ceil(most / block)))
    placed = values.withColumn("block", F.pmod(F.xxhash64(*AGENT), F.lit(blocks)).cast("int"))
    sizes: dict[str, np.ndarray] = {}
    for r in placed.groupBy("metric", "block").count().collect():
        sizes.setdefault(r["metric"], np.zeros(blocks, dtype=np.int64))[r["block"]] = r["count"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values([*AGENT, "value"])["value"].to_numpy()
        metric, place = group["metric"].iloc[0], int(group["block"].iloc[0])
        key = (seed % (1 << 63), int(group["metric_ord"].iloc[0]))
        draws = block_draws(sizes[metric], place, samples, key)
        pick = np.random.default_rng([*key, place])
        totals = [float(own[pick.integers(0, len(own), n)].sum()) for n in draws]
        return pd.DataFrame({"metric": metric, "b": np.arange(samples, dtype=np.int64), "total": totals, "n": draws})

    return placed.groupBy("metric", "block").applyInPandas(run, "metric string, b long, total double, n long")


def bootstrap_split(values: DataFrame, samples: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(metric, lower, upper) from values (metric, metric_ord, scenario_id, agent_id, value): a distributed bootstrap of the exact size.

    Each resample draws exactly as many values as there are, with replacement, as bootstrap_exact()
    does with another generator; a task holds one block of values.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    sums = resampled_sums(values, samples, seed, block)
    return _bounds(sums.groupBy("metric", "b").agg((F.sum("total") / F.sum("n")).alias("mean")), samples)
