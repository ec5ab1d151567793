"""From scored pairs to matches, and their evaluation.  Pairs have s1, t and p; truth has s1 and t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

GRID = [round(0.20 + 0.025 * i, 3) for i in range(31)]


def context(pairs: DataFrame, *columns: str) -> DataFrame:
    """For each column its gap to the group's best and its rank (falling), and the group's size."""
    w = Window.partitionBy("s1")
    out = pairs.withColumn("n_cand", F.count("*").over(w))
    for c in columns:
        out = out.withColumn(f"{c}_gap", F.round(F.max(c).over(w) - F.col(c), 6)).withColumn(f"{c}_rank", F.rank().over(w.orderBy(F.desc(c))))
    return out


def anchors(pairs: DataFrame, top: int = 3) -> DataFrame:
    """s1, t, anc_best, anc_n: support from the ``top`` best other candidates of the same s1; -1 if there is none."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "t"))
    best = pairs.withColumn("rn", rank).filter(F.col("rn") <= top).select(F.col("s1").alias("q"), F.col("t").alias("o"), F.col("p").alias("po"))
    joined = pairs.join(best, (F.col("s1") == F.col("q")) & (F.col("t") != F.col("o")), "left")
    return joined.groupBy("s1", "t").agg(F.coalesce(F.max("po"), F.lit(-1.0)).alias("anc_best"), F.count("o").alias("anc_n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """Stage-two features of the sorted list: best values, neighbours' gaps, counts over one half and nine tenths."""
    w = Window.partitionBy("s1")
    o = w.orderBy(F.desc("p"), "t")
    out = pairs.withColumn("pos", F.row_number().over(o) - 1)
    kth = lambda k: F.coalesce(F.max(F.when(F.col("pos") == k, F.col("p"))).over(w), F.lit(0.0))
    return out.select(
        "s1", "t", "pos", F.max("p").over(w).alias("p_max"), kth(1).alias("p_2"), kth(2).alias("p_3"), F.round(F.sum("p").over(w), 6).alias("p_sum"),
        F.round(F.col("p") - F.lead("p", 1, 0.0).over(o), 6).alias("gap_next"), F.round(F.lag("p", 1, 1.0).over(o) - F.col("p"), 6).alias("gap_prev"),
        F.count_if(F.col("p") >= 0.5).over(w).alias("n_p50"), F.count_if(F.col("p") >= 0.9).over(w).alias("n_p90"),
    )


def survivors(pairs: DataFrame, n: int, floor: float = 0.001) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "t"))
    return pairs.withColumn("rn", rank).filter((F.col("rn") <= n) & (F.col("p") >= floor)).drop("rn")


def owners(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Each target's best pair (ties to the lesser s1); the threshold is filtered first, which gives the same and less to sort."""
    own = pairs if threshold is None else pairs.filter(F.col("p") >= threshold)
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("p"), "s1"))
    return own.withColumn("rn", rank).filter("rn = 1").drop("rn")


def owners_with_ties(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("best", F.max("p").over(Window.partitionBy("t"))).filter("p = best").drop("best")


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def blend(p: Column, q: Column, alpha: float) -> Column:
    z = (1 - alpha) * logit(p) + alpha * logit(q)
    return 1 / (1 + F.exp(-z))


def per_entity(entities: DataFrame, matches: DataFrame, truth: DataFrame, beta2: float = 0.25) -> DataFrame:
    """s1, g, n, tp, f of every entity: F0.5 = 5 tp / (4 n + g); no truth and no match is 1. One shuffle by s1."""
    own = truth.select("s1", "t", F.lit(1).alias("g"), F.lit(0).alias("n")).unionByName(matches.select("s1", "t", F.lit(0).alias("g"), F.lit(1).alias("n")))
    both = own.groupBy("s1", "t").agg(F.max("g").alias("g"), F.max("n").alias("n"))
    counts = both.groupBy("s1").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum(F.col("g") * F.col("n")).alias("tp"))
    out = entities.select("s1").join(counts, "s1", "left").na.fill(0)
    f = F.when((F.col("g") == 0) & (F.col("n") == 0), 1.0).otherwise((1 + beta2) * F.col("tp") / (F.col("n") + beta2 * F.col("g")))
    return out.withColumn("f", f)


def oracle(entities: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """The best F that choosing among the candidates can reach, by entity."""
    reached = candidates.join(truth, ["s1", "t"], "left_semi")
    return per_entity(entities, reached, truth)


def sweep(entities: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """theta, macro_f in one pass: each owned pair counts for all thresholds it reaches, each entity sums once a threshold."""
    own = owners(pairs).join(truth.withColumn("hit", F.lit(1)), ["s1", "t"], "left").select("s1", "p", F.coalesce("hit", F.lit(0)).alias("hit"))
    per = own.groupBy("s1").agg(*[F.struct(F.count_if(F.col("p") >= x).alias("n"), F.sum(F.when(F.col("p") >= x, F.col("hit")).otherwise(0)).alias("tp")).alias(f"x{i}") for i, x in enumerate(grid)])
    g = truth.groupBy("s1").agg(F.count("*").alias("g"))
    all_ = entities.select("s1").join(per, "s1", "left").join(g, "s1", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    f = lambda i: F.when((F.col("g") == 0) & (F.coalesce(F.col(f"x{i}.n"), F.lit(0)) == 0), 1.0).otherwise(5 * F.coalesce(F.col(f"x{i}.tp"), F.lit(0)) / (4 * F.coalesce(F.col(f"x{i}.n"), F.lit(0)) + F.col("g")))
    wide = all_.agg(*[F.avg(f(i)).alias(f"m{i}") for i in range(len(grid))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("theta"), F.round(f"m{i}", 6).alias("macro_f")) for i, x in enumerate(grid)])).alias("r")).select("r.*")


def losses(entities: DataFrame, matches: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """s1 and the exact parts of 1 - F: truth not retrieved, truth retrieved but not chosen, wrong matches."""
    f, u = per_entity(entities, matches, truth), oracle(entities, candidates, truth).select("s1", F.col("tp").alias("r"))
    own = f.join(u, "s1").withColumn("wrong", F.col("n") - F.col("tp"))
    best = F.when(F.col("g") == 0, 1.0).otherwise(5 * F.col("r") / (4 * F.col("r") + F.col("g")))
    clean = F.when(F.col("g") == 0, 1.0).otherwise(5 * F.col("tp") / (4 * F.col("tp") + F.col("g")))
    return own.select("s1", F.round(1 - best, 6).alias("retrieval"), F.round(best - clean, 6).alias("missed"), F.round(clean - F.col("f"), 6).alias("false_positive"), F.round("f", 6).alias("f"))


def slices(scored: DataFrame) -> DataFrame:
    """Means over all, by country, by number of true matches and by both: grouping sets in one pass."""
    return scored.groupingSets([[], ["country"], ["g"], ["country", "g"]], "country", "g").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f")).select("level", "country", "g", "entities", "macro_f")


def bootstrap(scored: DataFrame, reps: int = 200, seed: int = 7) -> DataFrame:
    """lo, mean, hi of the macro mean: Poisson weights from a hash of entity and repetition, so nothing is gathered."""
    cuts, mass = [], 0.0
    for k in range(8):
        mass += math.exp(-1.0) / math.factorial(k)
        cuts.append(mass)
    u = F.pmod(F.xxhash64("s1", F.lit(seed), "rep"), F.lit(1 << 30)) / float(1 << 30)
    weight = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < u))
    drawn = scored.select("s1", "f", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("w", weight)
    means = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("hi"))


def best_prefix(p: list[float], beta2: float = 0.25) -> int:
    """How many of the falling probabilities to take for the greatest expected F: sums over Poisson-binomial counts."""
    p = [float(q) for q in p]
    tail = [np.array([1.0])]
    for q in reversed(p):
        tail.append(np.convolve(tail[-1], [1 - q, q]))
    tail.reverse()  # tail[k]: how many of p[k:] are true
    best, value, head = 0, float(tail[0][0]), np.array([1.0])
    for k in range(1, len(p) + 1):
        head = np.convolve(head, [1 - p[k - 1], p[k - 1]])
        tp, rest = np.arange(k + 1)[:, None], np.arange(len(tail[k]))[None]
        expected = float((head[:, None] * tail[k][None] * (1 + beta2) * tp / (k + beta2 * (tp + rest))).sum())
        if expected > value + 1e-12:
            best, value = k, expected
    return best


@pandas_udf(IntegerType())
def _best_prefix(p: pd.Series) -> pd.Series:
    return p.map(best_prefix).astype("int32")


def expected_f(pairs: DataFrame) -> DataFrame:
    """s1, t, p: the prefix of each entity's whole list with the greatest expected F0.5."""
    lists = pairs.filter(F.col("p") >= 0).groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("t").alias("t")))).alias("c"))
    chosen = lists.withColumn("k", _best_prefix(F.transform("c", lambda x: -x["o"])))
    return chosen.select("s1", F.explode(F.slice("c", F.lit(1), F.col("k"))).alias("c")).select("s1", "c.t", (-F.col("c.o")).alias("p"))


def violations(entities: DataFrame, targets: DataFrame, lists: DataFrame, candidate_lists: DataFrame) -> DataFrame:
    """kind, n of broken rules of an output: rows an entity, coverage, unknown and repeated ids, matches among candidates."""
    own = lists.select("source1_entity_id", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda t: t != "")).alias("t"))
    could = candidate_lists.select("source1_entity_id", F.explode(F.split("candidate_entity_ids", ",")).alias("t"))
    known = entities.select(F.col("entity_id").alias("source1_entity_id"))
    checks = {
        "repeated_row": lists.groupBy("source1_entity_id").count().filter("count > 1"),
        "unknown_entity": lists.join(known, "source1_entity_id", "left_anti"),
        "missing_entity": known.join(lists, "source1_entity_id", "left_anti"),
        "unknown_target": own.join(targets.select(F.col("entity_id").alias("t")), "t", "left_anti"),
        "repeated_target": own.groupBy("source1_entity_id", "t").count().filter("count > 1"),
        "shared_target": own.groupBy("t").agg(F.count_distinct("source1_entity_id").alias("n")).filter("n > 1"),
        "not_a_candidate": own.join(could, ["source1_entity_id", "t"], "left_anti"),
    }
    out = None
    for kind, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
