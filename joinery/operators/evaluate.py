"""Evaluation, diagnosis and guards.  Everything is an aggregate over entities, pairs or lists; nothing is collected but single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as x
from . import decide

COARSE = sorted({round(0.2 + 0.02 * i, 4) for i in range(39)} | {0.97, 0.98, 0.99})


def fine_sweep(entities: DataFrame, pairs: DataFrame, truth: DataFrame, coarse: list[float] = COARSE, step: float = 0.0025, reach: float = 0.02) -> DataFrame:
    """theta, macro_f, best: a coarse grid, then a fine one about its best threshold (of equals the lowest)."""
    rough = decide.sweep(entities, pairs, truth, coarse)
    top = rough.agg(F.max_by("theta", F.struct("macro_f", -F.col("theta"))).alias("theta")).first().theta
    n = int(round(reach / step))
    fine = sorted({round(top + step * i, 4) for i in range(-n, n + 1) if 0.05 <= top + step * i <= 0.995} | {top})
    out = decide.sweep(entities, pairs, truth, fine)
    best = F.max(F.struct("macro_f", (-F.col("theta")).alias("m"))).over(Window.partitionBy(F.lit(0)))  # a row a threshold
    return out.withColumn("best", F.struct("macro_f", (-F.col("theta")).alias("m")) == best)


def sweep_by_slice(entities: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float] = decide.GRID) -> DataFrame:
    """country, theta: each country's best threshold (of equals the lowest), from one owner assignment over all."""
    own = decide.owners(pairs).join(truth.withColumn("hit", F.lit(1)), ["s1", "t"], "left").select("s1", F.explode(F.array(*map(F.lit, grid))).alias("theta"), "p", F.coalesce("hit", F.lit(0)).alias("hit"))
    per = own.filter("p >= theta").groupBy("s1", "theta").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"))
    g = truth.groupBy("s1").agg(F.count("*").alias("g"))
    every = entities.select("s1", "country", F.explode(F.array(*map(F.lit, grid))).alias("theta")).join(per, ["s1", "theta"], "left").join(g, "s1", "left").fillna(0, ["n", "tp", "g"])
    f = F.when((F.col("g") == 0) & (F.col("n") == 0), 1.0).otherwise(5 * F.col("tp") / (4 * F.col("n") + F.col("g")))
    means = every.groupBy("country", "theta").agg(F.round(F.avg(f), 6).alias("macro_f"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("macro_f"), "theta"))
    return means.withColumn("rn", rank).filter("rn = 1").drop("rn")


def decided_by_slice(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Owners whose p reaches their country's threshold (pairs have country; thresholds a row a country)."""
    return decide.owners(pairs.join(F.broadcast(thresholds.select("country", "theta")), "country").filter("p >= theta")).drop("theta")


def blocking_report(entities: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """By country: links, found, pairs an entity, and the share of entities without candidates."""
    n = candidates.groupBy("s1").agg(F.count("*").alias("n"))
    hit = truth.join(candidates.select("s1", "t", F.lit(1).alias("hit")), ["s1", "t"], "left").groupBy("s1").agg(F.count("*").alias("links"), F.count("hit").alias("found"))
    own = entities.join(n, "s1", "left").join(hit, "s1", "left").fillna(0, ["n", "links", "found"])
    return own.groupBy("country").agg(
        F.sum("links").alias("links"), F.sum("found").alias("found"), F.round(F.avg("n"), 6).alias("pairs_per_entity"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("none_share"), F.percentile("n", 0.95).alias("pairs_p95")
    )


def missed_by_key(truth: DataFrame, candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """kind, shared: of the true pairs that are no candidates, how many share a key of each kind (which a cap or the top-k lost)."""
    missed = truth.join(candidates.select("s1", "t"), ["s1", "t"], "left_anti")
    own = missed.join(keys.select(F.col("id").alias("s1"), "kind", "key"), "s1").join(keys.select(F.col("id").alias("t"), "kind", "key"), ["t", "kind", "key"])
    return own.groupBy("kind").agg(F.count_distinct("s1", "t").alias("shared"))


def paired_delta(a: DataFrame, b: DataFrame, entities: DataFrame) -> DataFrame:
    """By country, and for all (null): mean difference of two systems' F over the same entities, its standard error, and how many are better or worse."""
    both = a.select("s1", F.col("f").alias("fa")).join(b.select("s1", F.col("f").alias("fb")), "s1").join(entities.select("s1", "country"), "s1")
    d = F.col("fa") - F.col("fb")
    out = both.rollup("country").agg(
        F.count("*").alias("entities"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d) / F.sqrt(F.count("*")), 6).alias("se"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse")
    )
    return out


def cut_grid(entities: DataFrame, pairs: DataFrame, truth: DataFrame, cuts: list[tuple[int, float]]) -> DataFrame:
    """n, floor, pairs, entities, recall and oracle_u of every cut of the candidates: ranks are taken once, each cut is a filter."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "t"))
    own = pairs.select("s1", "t", "p").withColumn("rn", rank).join(truth.withColumn("hit", F.lit(1)), ["s1", "t"], "left")
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("floor")) for n, f in cuts])).alias("cut")
    kept = own.select("s1", "p", "rn", "hit", grid).filter((F.col("rn") <= F.col("cut.n")) & (F.col("p") >= F.col("cut.floor")))
    per = kept.groupBy("s1", "cut").agg(F.count("*").alias("c"), F.count("hit").alias("r"))
    g = truth.groupBy("s1").agg(F.count("*").alias("g"))
    every = entities.select("s1", grid).join(per, ["s1", "cut"], "left").join(g, "s1", "left").fillna(0, ["c", "r", "g"])
    u = F.when(F.col("g") == 0, 1.0).otherwise(5 * F.col("r") / (4 * F.col("r") + F.col("g")))
    return every.groupBy("cut").agg(F.sum("c").alias("pairs"), F.count_if(F.col("c") > 0).alias("entities"), F.round(F.sum("r") / F.sum("g"), 6).alias("recall"), F.round(F.avg(u), 6).alias("oracle_u")).select("cut.n", "cut.floor", "pairs", "entities", "recall", "oracle_u")


def recall_grid(candidates: DataFrame, truth: DataFrame, entities: DataFrame, ks: tuple[int, ...], by: str = "bscore") -> DataFrame:
    """country, k, found, pairs: retrieval at several k by country, ranked once."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc(by), "t"))
    own = candidates.withColumn("rn", rank).join(truth.withColumn("hit", F.lit(1)), ["s1", "t"], "left").join(entities.select("s1", "country"), "s1")
    long = own.select("country", "hit", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rn"))).alias("k"))
    return long.groupBy("country", "k").agg(F.count("hit").alias("found"), F.count("*").alias("pairs"))


def residuals(pairs: DataFrame, truth: DataFrame, joined: DataFrame, theta: float) -> DataFrame:
    """kind, n and shares: rejected truth, false positives, accepted truth and other negatives, by what their records have in common."""
    names = [F.array_distinct(x.tokens(F.coalesce(f"{p}_core", F.lit("")))) for p in "qt"]
    own = joined.join(pairs.select("s1", "t", "p"), ["s1", "t"]).join(truth.withColumn("y", F.lit(1)), ["s1", "t"], "left")
    kind = F.when(F.col("y").isNotNull(), F.when(F.col("p") < theta, "rejected").otherwise("accepted")).otherwise(F.when(F.col("p") >= theta, "false_pos").otherwise("negative"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return own.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), share(F.size(F.array_intersect(*names)) == 0).alias("name_disjoint"), share((F.col("q_addr_norm") == "") | (F.col("t_addr_norm") == "")).alias("addr_missing"), share(sim.equal_flag(F.col("q_house"), F.col("t_house")) == 0).alias("house_diff"),
    )


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the text between two spaces."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def signals(joined: DataFrame) -> DataFrame:
    """s1, t and what true pairs have in common: tokens, trigrams, numbers; ``edge`` is a shared name token or a trigram Jaccard of 0.25."""
    token = lambda view: F.size(F.array_intersect(*[F.array_distinct(x.tokens(F.coalesce(f"{p}_{view}", F.lit("")))) for p in "qt"])) > 0
    digits = [F.array_distinct(F.regexp_extract_all(F.coalesce(f"{p}_addr_norm", F.lit("")), F.lit(r"\d+"), F.lit(0))) for p in "qt"]
    both, n, m = sim.set_counts(*digits)
    like = sim.jaccard(*[trigrams(F.coalesce(f"{p}_name_norm", F.lit(""))) for p in "qt"])
    return joined.select(
        "s1", "t", "q_country", (F.col("q_name_norm") == F.col("t_name_norm")).alias("name_exact"), ((F.col("q_addr_norm") != "") & (F.col("q_addr_norm") == F.col("t_addr_norm"))).alias("address_exact"),
        (F.col("t_addr_norm") == "").alias("address_missing"), token("name_norm").alias("name_token"), F.round(like, 6).alias("trigram"), token("addr_norm").alias("address_token"), ((n > 0) & (m > 0) & (both == 0)).alias("numbers_disjoint"),
    ).withColumn("edge", F.col("name_token") | (F.col("trigram") >= 0.25))


def noise_profile(signalled: DataFrame) -> DataFrame:
    """country, pairs, and how many pairs have each signal."""
    flags = ("name_exact", "address_exact", "address_missing", "name_token", "address_token", "numbers_disjoint", "edge")
    return signalled.groupBy(F.col("q_country").alias("country")).agg(F.count("*").alias("pairs"), *[F.count_if(f).alias(f) for f in flags], F.count_if(F.col("trigram") >= 0.5).alias("trigram_050"))


def bridged(truth: DataFrame, records: DataFrame, rounds: int = 4) -> DataFrame:
    """s1, g, direct, connected: true variants with an edge to their s1, and those reached over other true variants.

    Edges lie within an entity, whose variants are few, so a round is a join on s1; ``rounds`` is the longest path that is followed,
    and an entity with no more variants than that is complete.
    """
    views = ["name_norm"]
    side = lambda k, p: records.select(F.col("id").alias(k), *[F.coalesce(c, F.lit("")).alias(f"{p}_{c}") for c in views])
    token = F.size(F.array_intersect(*[F.array_distinct(x.tokens(F.col(f"{p}_name_norm"))) for p in "ab"])) > 0
    near = token | (sim.jaccard(trigrams(F.col("a_name_norm")), trigrams(F.col("b_name_norm"))) >= 0.25)
    own = truth.select("s1", "t")
    direct = own.join(side("s1", "a"), "s1").join(side("t", "b"), "t").filter(near).select("s1", "t")
    among = own.select("s1", F.col("t").alias("u")).join(own, "s1").filter("u <> t").join(side("u", "a"), "u").join(side("t", "b"), "t").filter(near).select("s1", "u", "t")
    reached = direct
    for _ in range(rounds):
        reached = reached.unionByName(reached.select("s1", F.col("t").alias("u")).join(among, ["s1", "u"]).select("s1", "t")).distinct()
    g = own.groupBy("s1").agg(F.count("*").alias("g"))
    n = lambda df, c: df.groupBy("s1").agg(F.count("*").alias(c))
    return g.join(n(direct, "direct"), "s1", "left").join(n(reached, "connected"), "s1", "left").fillna(0)


def histogram(frame: DataFrame, column: str, borders: list[float]) -> DataFrame:
    """bin, n: how many values are over each border up to the next; bin -1 is missing."""
    bin_ = F.when(F.col(column).isNull(), -1).otherwise(sum((F.col(column) > b).cast("int") for b in borders))
    return frame.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def integrity(frame: DataFrame, keys: list[str]) -> DataFrame:
    """column, nulls, not_finite of every column, and the number of repeated keys as the row '(keys)'."""
    numeric = {f.name for f in frame.schema if f.dataType.typeName() in ("double", "float")}
    odd = lambda c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) if c in numeric else F.lit(0).cast("long")
    wide = frame.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), odd(c).alias("not_finite")).alias(c) for c in frame.columns])
    each = wide.select(F.explode(F.array(*frame.columns)).alias("r")).select("r.*")
    twice = frame.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("nulls")).select(F.lit("(keys)").alias("column"), "nulls", F.lit(0).cast("long").alias("not_finite"))
    return each.unionByName(twice)


def digest(frame: DataFrame) -> DataFrame:
    """n and an order-free digest of rows, equal for equal bags of rows."""
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def gate(delta: DataFrame, least: float = 0.0015, z: float = 1.645, slices: tuple[str, ...] = ()) -> DataFrame:
    """passed: the gain is large enough and surely positive over all, and no named slice loses (``delta`` as of paired_delta)."""
    whole, named = F.col("country").isNull(), F.col("country").isin(list(slices)) if slices else F.lit(False)
    good = F.when(whole, (F.col("mean") >= least) & (F.col("mean") - z * F.col("se") > 0)).when(named, F.col("mean") >= 0).otherwise(True)
    return delta.agg(F.bool_and(good).alias("passed"))


def output_profile(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """country, entities, mean_predicted, empty, eight_plus: label-free rates of an output."""
    n = matches.groupBy("s1").agg(F.count("*").alias("n"))
    own = entities.join(n, "s1", "left").fillna(0, ["n"])
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return own.groupBy("country").agg(F.count("*").alias("entities"), F.round(F.avg("n"), 6).alias("mean_predicted"), share(F.col("n") == 0).alias("empty"), share(F.col("n") >= 8).alias("eight_plus"))


def routed(matches: DataFrame, fallback: DataFrame, profile: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """s1, t: a country's rows, or the fallback's where one of its rates leaves its band (matches and fallback have country)."""
    bad = F.lit(False)
    for rate, (low, high) in bands.items():
        bad = bad | (F.col(rate) < low) | (F.col(rate) > high)
    out = F.broadcast(profile.filter(bad).select("country"))  # a row a country
    return matches.join(out, "country", "left_anti").select("s1", "t").unionByName(fallback.join(out, "country", "left_semi").select("s1", "t"))


def ledger(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """n, entities: how many entities have how many candidates, none included."""
    n = candidates.groupBy("s1").agg(F.count("*").alias("n"))
    return entities.join(n, "s1", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("entities"))


def conformance(pairs: DataFrame, n: int, floor: float, countries: DataFrame) -> DataFrame:
    """rule, broken: a cut's guarantees: at most n an entity, none under the floor, no pair twice, no target wanted in two countries."""
    per = pairs.groupBy("s1").agg(F.count("*").alias("c")).filter(F.col("c") > n)
    twice = pairs.groupBy("s1", "t").agg(F.count("*").alias("c")).filter("c > 1")
    across = pairs.join(countries.select("s1", "country"), "s1").groupBy("t").agg(F.count_distinct("country").alias("c")).filter("c > 1")
    rules = {"over_n": per, "under_floor": pairs.filter(F.col("p") < floor), "repeated": twice, "two_countries": across}
    out = None
    for rule, bad in rules.items():
        one = bad.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


def covers_once(pairs: DataFrame, frame: DataFrame) -> DataFrame:
    """s1, t, rows of pairs that a frame does not have exactly once: empty if it covers them."""
    got = frame.groupBy("s1", "t").agg(F.count("*").alias("rows"))
    return pairs.select("s1", "t").distinct().join(got, ["s1", "t"], "full").select("s1", "t", F.coalesce("rows", F.lit(0)).alias("rows")).filter("rows <> 1")
