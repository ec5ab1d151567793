"""Features of candidate pairs: similarities, flags, context, anchors, siblings, rivals, decoys.

Pairs have s1 and t; records are those of ``linkage.normalise``.  Everything but the indel ratios is JVM
expressions, windows and equi-joins on keys that pairs or targets carry.  The ratios of a feature family
are one Arrow pass over the joined rows (``with_similarities``).  Rival postings are cut at a fixed number
a key and told as overflow, as their definition says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as x
from . import decide, linkage

VIEWS = ("name_norm", "core", "skel", "concat", "addr_norm", "addr_tok", "postcode", "house", "country", "src")
#: Scorers by name, of lists of strings: add one here and every feature family can use it.
SCORERS = {"ratio": sim.indel_ratios, "partial": sim.best_windows, "tsort": sim.token_sort_ratios, "tset": sim.token_set_ratios, "jw": lambda a, b: 100 * sim.winklers(a, b)}
#: Feature: scorer, view, and its value where a side is empty (None: the scorer's own).
PAIR = {
    "n_ratio": ("ratio", "name_norm", None), "n_partial": ("partial", "name_norm", None), "n_tsort": ("tsort", "name_norm", None), "n_tset": ("tset", "name_norm", None),
    "c_ratio": ("ratio", "core", None), "c_tset": ("tset", "core", None), "c_jw": ("jw", "core", None), "sk_ratio": ("ratio", "skel", None), "sk_tset": ("tset", "skel", None),
    "cc_ratio": ("ratio", "concat", None), "cc_partial": ("partial", "concat", None),
    "a_ratio": ("ratio", "addr_norm", -1.0), "a_partial": ("partial", "addr_norm", -1.0), "a_tsort": ("tsort", "addr_norm", -1.0), "a_tset": ("tset", "addr_norm", -1.0),
    "at_ratio": ("ratio", "addr_tok", -1.0), "at_tset": ("tset", "addr_tok", -1.0),
}
PAIR_CONTEXT = ("n_tset", "a_tset", "cc_ratio", "at_tset", "bscore")


def sides(pairs: DataFrame, records: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Pairs with the views of both records, as q_* and t_*."""
    side = lambda k, p, src: records.filter(src).select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in views])
    return pairs.join(side("s1", "q", "src = 1"), "s1").join(side("t", "t", "src > 1"), "t")


def with_similarities(frame: DataFrame, specs: dict[str, tuple[str, str, str, float | None]]) -> DataFrame:
    """The frame with a column a spec (scorer, left, right, value where a side is empty), in one Arrow pass."""
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {c: [v or "" for v in b.column(c).to_pylist()] for c in {c for _, p, q, _ in specs.values() for c in (p, q)}}
            out = []
            for scorer, p, q, empty in specs.values():
                values = sim.distinct_pairs(SCORERS[scorer], lists[p], lists[q])
                if empty is not None and len(values):
                    values = np.where([not a or not c for a, c in zip(lists[p], lists[q], strict=True)], empty, values)
                out.append(pc.if_else(pc.is_nan(pa.array(values, pa.float64())), pa.scalar(None, pa.float64()), pa.array(np.round(values, 6), pa.float64())))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*names, *specs])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema]
    return frame.mapInArrow(run, ", ".join([*kept, *[f"`{n}` double" for n in specs]]))


def of_views(specs: dict[str, tuple[str, str, float | None]], left: str = "q", right: str = "t", prefix: str = "") -> dict[str, tuple[str, str, str, float | None]]:
    return {f"{prefix}{n}": (s, f"{left}_{view}", f"{right}_{view}", empty) for n, (s, view, empty) in specs.items()}


def _len(c: str) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def flags(joined: DataFrame, keys: str = "ABCDEFG") -> DataFrame:
    """Equality flags, lengths, source, score and key bits of joined pairs (with bscore and kmask)."""
    words = lambda c: F.regexp_count(c, F.lit(" ")) + 1
    shape = [
        (F.col("q_name_norm") == F.col("t_name_norm")).cast("int").alias("n_exact"), ((F.col("q_core") == F.col("t_core")) & (F.col("q_core") != "")).cast("int").alias("c_exact"),
        sim.equal_flag(F.col("q_postcode"), F.col("t_postcode")).alias("pc_eq"), sim.equal_flag(F.col("q_house"), F.col("t_house")).alias("hs_eq"), sim.equal_flag(F.col("q_country"), F.col("t_country")).alias("cty_eq"),
        _len("q_name_norm").alias("n_len1"), _len("t_name_norm").alias("n_len2"), _len("q_addr_norm").alias("a_len1"), _len("t_addr_norm").alias("a_len2"),
        F.round(F.least(words("q_name_norm"), words("t_name_norm")) / F.greatest(words("q_name_norm"), words("t_name_norm")), 6).alias("ntok_r"), F.col("t_src").alias("src"), "bscore",
    ]
    return joined.select("*", *[c for c in shape if not isinstance(c, str)], *[F.getbit("kmask", F.lit(linkage.BITS[k])).cast("int").alias(f"k{k}") for k in keys])


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The 47 features of pairs (s1, t, bscore, kmask): similarities, flags, lengths, key bits, and gaps and ranks among the candidates of an s1."""
    own = flags(with_similarities(sides(pairs, records), of_views(PAIR)))
    own = decide.context(own, *PAIR_CONTEXT)
    return own.select("s1", "t", *[c for c in own.columns if c not in ("s1", "t", "kmask") and not c.startswith(("q_", "t_"))])


def token_features(joined: DataFrame) -> DataFrame:
    """Shares and counts of shared, extra and missing name tokens and address numbers."""
    names = [F.array_distinct(x.tokens(F.coalesce(f"{p}_core", F.lit("")))) for p in "qt"]
    digits = [F.array_distinct(F.regexp_extract_all(F.coalesce(f"{p}_addr_norm", F.lit("")), F.lit(r"\d+"), F.lit(0))) for p in "qt"]
    both, n, m = sim.set_counts(*names)
    same, a, b = sim.set_counts(*digits)
    return joined.select(
        "s1", "t", F.round(sim.share(both, m), 6).alias("name_token_precision"), F.round(sim.share(both, n), 6).alias("name_token_recall"), (m - both).alias("name_extra_tokens"), (n - both).alias("name_missing_tokens"),
        F.round(sim.share(same, a + b - same), 6).alias("number_jaccard"), F.round(sim.share(same, b), 6).alias("number_precision"), F.round(sim.share(same, a), 6).alias("number_recall"),
        ((a == 0) | (b == 0)).cast("int").alias("number_missing"), ((n == 0) | (m == 0)).cast("int").alias("name_missing"), ((F.col("q_addr_norm") == "") | (F.col("t_addr_norm") == "")).cast("int").alias("address_missing"),
    )


def folded_features(joined: DataFrame) -> DataFrame:
    """Ratios of the folded (looser, sound-alike) name and address, -1 where a side is empty; gaps and ranks of them."""
    views = {f"{p}_{to}": x.folded(F.col(f"{p}_{view}")) for p in "qt" for to, view in (("name_fold", "core"), ("address_fold", "addr_tok"))}
    specs = {f"fold_{to}_{n}": (s, view, -1.0) for to, view in (("name", "name_fold"), ("addr", "address_fold")) for n, s in (("ratio", "ratio"), ("set", "tset"))}
    own = with_similarities(joined.select("s1", "t", *[c.alias(n) for n, c in views.items()]), of_views(specs))
    return decide.context(own.select("s1", "t", *specs), "fold_name_ratio", "fold_addr_ratio")


def text_rank(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """s1, t, score: the better of name and address and a little of the other, each 0.7 token set and 0.3 ratio, 0 where a side is empty."""
    specs = {f"{n}_{s}": (s, view, 0.0) for n, view in (("n", "name_norm"), ("a", "addr_norm")) for s in ("tset", "ratio")}
    own = with_similarities(sides(pairs.select("s1", "t"), records, ("name_norm", "addr_norm")), of_views(specs))
    name, address = (0.7 * F.col(f"{p}_tset") + 0.3 * F.col(f"{p}_ratio") for p in "na")
    return own.select("s1", "t", F.round(F.greatest(name, address) + 0.05 * F.least(name, address), 6).alias("score"))


def label_free_cut(pairs: DataFrame, scores: list[str], n: int) -> DataFrame:
    """The n best candidates of each s1 by the sum of scores (missing: 0; ties to the lesser t)."""
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in scores)
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("_sum"), "t"))
    return pairs.withColumn("_sum", F.round(total, 6)).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_sum", "_rank")


def anchor_features(pairs: DataFrame, records: DataFrame, top: int = 3) -> DataFrame:
    """Of pairs with c_tset, n_tset and a_tset: the heuristic score, its gap and rank, and likeness to the s1's ``top`` best other candidates."""
    address = F.when(F.col("a_tset") >= 0, F.col("a_tset")).otherwise(F.col("c_tset"))
    w = Window.partitionBy("s1")
    own = pairs.select("s1", "t", F.round((F.col("c_tset") + F.col("n_tset") + 2 * address) / 4, 6).alias("h_score"))
    own = own.withColumn("h_gap", F.round(F.max("h_score").over(w) - F.col("h_score"), 6)).withColumn("h_rank", F.row_number().over(w.orderBy(F.desc("h_score"), "t")))
    views = lambda k, p: records.filter("src > 1").select(F.col("id").alias(k), F.col("core").alias(f"{p}_core"), F.col("addr_norm").alias(f"{p}_addr_norm"))
    best = own.filter(F.col("h_rank") <= top).select("s1", F.col("t").alias("o"), F.col("h_score").alias("o_h"), F.col("h_rank").alias("o_rank"))
    met = own.select("s1", "t").join(best, "s1").filter("t <> o").join(views("t", "c"), "t").join(views("o", "o"), "o")
    met = with_similarities(met, {"ns": ("tset", "c_core", "o_core", None), "as": ("tset", "c_addr_norm", "o_addr_norm", -1.0)})
    support = F.round((F.col("ns") + F.greatest("as", F.lit(0.0))) / 200 * F.col("o_h"), 6)
    per = met.groupBy("s1", "t").agg(
        F.min_by("ns", "o_rank").alias("anc_name_top"), F.min_by("as", "o_rank").alias("anc_addr_top"), F.max("ns").alias("anc_name_max"), F.max("as").alias("anc_addr_max"), F.min_by("o_h", "o_rank").alias("anc_h_top"), F.max(support).alias("anc_support")
    )
    return own.join(per, ["s1", "t"], "left").fillna(-1.0)


#: Similarities of two records used for survivors and siblings: scorer, view, value where a side is empty.
TEXT = {
    "n_tset": ("tset", "core", -1.0), "n_tsort": ("tsort", "core", -1.0), "cc_ratio": ("ratio", "concat", -1.0), "cc_jw": ("jw", "concat", -1.0),
    "a_tset": ("tset", "addr_norm", -1.0), "a_ratio": ("ratio", "addr_norm", -1.0), "at_tset": ("tset", "addr_tok", -1.0),
}
SIBLINGS = ("n_tset", "cc_ratio", "a_tset", "at_tset", "a_eq", "hs_eq", "n_eq")


def text_block(joined: DataFrame, left: str, right: str, prefix: str = "") -> DataFrame:
    """The frame with similarities, equality flags and shared tokens of its two records."""
    # name similarities are missing where a core is empty, whichever view they read
    own = with_similarities(joined, of_views(TEXT, left, right, prefix))
    no_name = (F.coalesce(f"{left}_core", F.lit("")) == "") | (F.coalesce(f"{right}_core", F.lit("")) == "")
    for c in ("cc_ratio", "cc_jw"):
        own = own.withColumn(f"{prefix}{c}", F.when(no_name, -1.0).otherwise(F.col(f"{prefix}{c}")))
    for to, view in (("n_eq", "core"), ("a_eq", "addr_norm"), ("hs_eq", "house"), ("pc_eq", "postcode")):
        own = own.withColumn(f"{prefix}{to}", sim.equal_flag(F.col(f"{left}_{view}"), F.col(f"{right}_{view}")))
    tokens = [F.array_distinct(x.tokens(F.coalesce(f"{p}_core", F.lit("")))) for p in (left, right)]
    return own.withColumn(f"{prefix}n_shared", F.size(F.array_intersect(*tokens)))


def sibling_features(survivors: DataFrame, records: DataFrame, siblings: int = 5) -> DataFrame:
    """s1, t and what the ``siblings`` best other survivors of the s1 say of each survivor (s1, t, p); -1 where there are none."""
    o = Window.partitionBy("s1").orderBy(F.desc("p"), "t")
    own = survivors.select("s1", "t", "p").withColumn("rank", F.row_number().over(o) - 1)
    views = ("core", "concat", "addr_norm", "addr_tok", "house", "postcode")
    side = lambda k, p: records.filter("src > 1").select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in views])
    top = own.filter(F.col("rank") <= siblings).select("s1", F.col("t").alias("o"), F.col("p").alias("ps"), F.col("rank").alias("rs"))
    met = own.select("s1", "t").join(top, "s1").filter("t <> o")
    met = met.withColumn("j", F.row_number().over(Window.partitionBy("s1", "t").orderBy("rs"))).filter(F.col("j") <= siblings)
    met = text_block(met.join(side("t", "c"), "t").join(side("o", "o"), "o"), "c", "o")
    sure = lambda cond: F.count_if((F.col("ps") >= 0.9) & cond)
    per = met.groupBy("s1", "t").agg(
        F.max("ps").alias("sib_pmax"),
        *[F.max(F.when(F.col("ps") >= 0.5, F.col(c).cast("double"))).alias(f"sibc_{c}") for c in SIBLINGS],
        *[F.round(F.max(F.greatest(F.col(c).cast("double"), F.lit(0.0)) * F.col("ps")), 6).alias(f"sibw_{c}") for c in SIBLINGS],
        sure(F.col("a_tset") >= 90).alias("sib_conf_addr"), sure(F.col("n_tset") >= 90).alias("sib_conf_name"), sure(F.col("hs_eq") == 1).alias("sib_conf_house"),
        sure(F.col("hs_eq") == 0).alias("sib_conf_house_diff"), sure(F.col("a_eq") == 1).alias("sib_conf_aeq"), sure(F.col("n_eq") == 1).alias("sib_conf_neq"),
        *[F.min_by(F.col(c).cast("double"), "j").alias(f"sib1_{c}") for c in SIBLINGS], F.min_by("ps", "j").alias("sib1_p"),
    )
    return own.select("s1", "t").join(per, ["s1", "t"], "left").fillna(-1)


RIVAL_VIEWS = ("core", "core_sorted", "concat", "skel", "addr_norm", "house_addr")


def rival_keys(records: DataFrame, least: int = 5) -> DataFrame:
    """id, src, key: a record's exact views of ``least`` letters or more, with country and the view's name."""
    house = F.when((F.coalesce("house", F.lit("")) != "") & (F.coalesce("addr_tok", F.lit("")) != ""), F.concat("house", F.lit(" "), "addr_tok"))
    views = {"core_sorted": x.sorted_tokens(F.col("core")), "house_addr": house}
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), views.get(n, F.col(n)).alias("value")) for n in RIVAL_VIEWS]))
    own = records.select("id", "src", F.coalesce("country", F.lit("")).alias("country"), long.alias("k"))
    return own.filter(F.length("k.value") >= least).select("id", "src", F.concat("country", F.lit("|"), "k.view", F.lit("|"), "k.value").alias("key")).distinct()


def rival_counts(records: DataFrame, most: int = 20, least: int = 5) -> DataFrame:
    """t, n_keys, overflow (a key with more than ``most`` s1 is not listed), n_rivals: s1 that share a listed key."""
    keys = rival_keys(records, least)
    posts = keys.filter("src = 1").groupBy("key").agg(F.count("*").alias("n"))
    own = keys.filter("src > 1").select(F.col("id").alias("t"), "key").join(posts, "key", "left")
    per = own.groupBy("t").agg(F.count("*").alias("n_keys"), F.max((F.coalesce("n", F.lit(0)) > most).cast("int")).alias("overflow"))
    found = rival_postings(records, most, least).groupBy("t").agg(F.count("*").alias("n_rivals"))
    return per.join(found, "t", "left").fillna(0, ["n_rivals"])


def rival_postings(records: DataFrame, most: int = 20, least: int = 5) -> DataFrame:
    """t, r: each target and the s1 that share one of its keys, of keys with at most ``most`` s1."""
    keys = rival_keys(records, least)
    small = keys.filter("src = 1").groupBy("key").agg(F.collect_list("id").alias("rs"), F.count("*").alias("n")).filter(F.col("n") <= most)
    return keys.filter("src > 1").select(F.col("id").alias("t"), "key").join(small, "key").select("t", F.explode("rs").alias("r")).distinct()


_RIVAL = {"n_tset": ("tset", "core", float("nan")), "n_ratio": ("ratio", "concat", float("nan")), "a_tset": ("tset", "addr_norm", float("nan")), "a_ratio": ("ratio", "addr_norm", float("nan"))}


def _rival_sims(met: DataFrame, records: DataFrame, other: str) -> DataFrame:
    """Pairs t, ``other`` with similarities from 0 to 1, null where a side is empty, and joint, the root of name by address ratio."""
    side = lambda k, p: records.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("core", "concat", "addr_norm")])
    own = with_similarities(met.join(side("t", "x"), "t").join(side(other, "y"), other), of_views(_RIVAL, "x", "y"))
    own = own.select("t", other, *[F.round(F.col(c) / 100, 6).alias(c) for c in _RIVAL])
    return own.withColumn("joint", F.round(F.sqrt(F.col("n_ratio") * F.col("a_ratio")), 6))


def rival_features(pairs: DataFrame, records: DataFrame, most: int = 20) -> DataFrame:
    """Each pair against the best rival of its target (another s1 that shares a key) by joint, name and address; null where there is none."""
    met = _rival_sims(rival_postings(records, most), records, "r")
    out = _rival_sims(pairs.select("s1", "t"), records, "s1")
    sims = [*_RIVAL, "joint"]
    out = out.select("s1", "t", *[F.col(c).alias(f"o_{c}") for c in sims])
    for name, by, keep in (("rJ", "joint", sims), ("rN", "n_ratio", ["n_ratio", "n_tset", "a_ratio"]), ("rA", "a_ratio", ["a_ratio", "a_tset", "n_ratio"])):
        rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc(by), "r"))
        two = met.filter(F.col(by).isNotNull()).withColumn("k", rank).filter("k <= 2")
        # a target's two best: one is not the pair's own s1
        listed = two.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "r", *keep))).alias("two"))
        out = out.join(listed, "t", "left").withColumn("_one", F.get(F.filter("two", lambda e: e["r"] != F.col("s1")), F.lit(0)))  # noqa: B023
        out = out.withColumns({f"{name}_r": F.col("_one.r"), f"{name}_present": F.col("_one").isNotNull().cast("int")} | {f"{name}_{c}": F.col(f"_one.{c}") for c in keep}).drop("two", "_one")
    gap = lambda own, other: F.round(F.col(f"o_{own}") - F.col(f"{other}_{own}"), 6)
    same = lambda a, b: (F.col(f"{a}_r") == F.col(f"{b}_r")).cast("int")
    out = out.withColumns({
        "gap_joint": gap("joint", "rJ"), "gap_J_name": gap("n_ratio", "rJ"), "gap_J_addr": gap("a_ratio", "rJ"), "gap_N_name": gap("n_ratio", "rN"), "gap_A_addr": gap("a_ratio", "rA"),
        "rN_is_J": same("rN", "rJ"), "rA_is_J": same("rA", "rJ"),
    })
    empty = lambda k: records.select(F.col("id").alias(k), (F.coalesce("addr_norm", F.lit("")) == "").cast("int").alias(f"{'q' if k == 's1' else 't'}_addr_missing"))
    counts = rival_counts(records, most).select("t", F.col("overflow").alias("t_overflow"), F.col("n_keys").alias("t_n_keys"))
    return out.drop("rJ_r", "rN_r", "rA_r").join(counts, "t", "left").fillna(0, ["t_overflow", "t_n_keys"]).join(empty("s1"), "s1").join(empty("t"), "t")


def offset_idf(records: DataFrame, view: str) -> DataFrame:
    """tok, idf over the targets: ln(N + 1) - ln(df + 1)."""
    targets = records.filter("src > 1")
    n = targets.agg(F.count("*").alias("n"))
    return linkage.document_frequency(targets, view).crossJoin(F.broadcast(n)).select("tok", (F.log(F.col("n") + 1) - F.log(F.col("df") + 1)).alias("idf"))  # one row


def coverage(pairs: DataFrame, records: DataFrame, view: str, prefix: str) -> DataFrame:
    """s1, t: IDF shares of each side's tokens that the other has, and sum and maximum of what is extra and missing; tokens no target has weigh most."""
    idf = offset_idf(records, view)
    most = idf.agg(F.max("idf").alias("top"))
    tokens = records.select("id", F.explode(F.array_distinct(x.tokens(F.coalesce(view, F.lit(""))))).alias("tok")).join(idf, "tok", "left").crossJoin(F.broadcast(most))  # one row
    lists = tokens.groupBy("id").agg(F.collect_list(F.struct("tok", F.coalesce("idf", "top").alias("w"))).alias("ws"))
    own = pairs.select("s1", "t").join(lists.select(F.col("id").alias("s1"), F.col("ws").alias("q")), "s1", "left").join(lists.select(F.col("id").alias("t"), F.col("ws").alias("u")), "t", "left")
    none = F.expr("cast(array() as array<struct<tok:string,w:double>>)")
    own = own.withColumn("q", F.coalesce("q", none)).withColumn("u", F.coalesce("u", none))
    names = lambda c: F.transform(c, lambda e: e["tok"])
    only = lambda a, b: F.filter(a, lambda e: ~F.array_contains(names(b), e["tok"]))
    # summed in the order of tokens, so that results do not depend on the order rows come in
    total = lambda c: F.aggregate(F.array_sort(c), F.lit(0.0), lambda s, e: s + e["w"])
    top = lambda c: F.coalesce(F.array_max(F.transform(c, lambda e: e["w"])), F.lit(0.0))
    own = own.withColumn("x", only("u", "q")).withColumn("m", only("q", "u")).withColumn("b", F.filter("q", lambda e: F.array_contains(names("u"), e["tok"])))
    six = lambda c, n: F.round(c, 6).alias(f"{prefix}_{n}")
    return own.select(
        "s1", "t", six(sim.share(total("b"), total("q")), "cov_q"), six(sim.share(total("b"), total("u")), "cov_t"), six(total("x"), "extra_idf"), six(top("x"), "extra_max"), six(total("m"), "miss_idf"), six(top("m"), "miss_max"),
        names("x").alias(f"{prefix}_extra"), names("m").alias(f"{prefix}_missing"),
    )


def true_differences(covered: DataFrame, records: DataFrame, view: str = "core", prefix: str = "nm", typo: float = 75.0) -> DataFrame:
    """Counts and greatest IDF of extra and missing tokens that are no typos of one another, and the true extra tokens."""
    idf = offset_idf(records, view)
    most = idf.agg(F.max("idf").alias("top"))
    crossed = covered.select("s1", "t", F.explode(f"{prefix}_extra").alias("x"), f"{prefix}_missing").select("s1", "t", "x", F.explode(f"{prefix}_missing").alias("m"))
    likes = with_similarities(crossed.select("x", "m").distinct(), {"r": ("ratio", "x", "m", None)}).filter(F.col("r") >= typo)
    typos = crossed.join(likes, ["x", "m"])
    out = covered.select("s1", "t")
    for kind, side, c in (("extra", "extra", "x"), ("miss", "missing", "m")):
        own = covered.select("s1", "t", F.explode(f"{prefix}_{side}").alias(c)).join(typos.select("s1", "t", c).distinct(), ["s1", "t", c], "left_anti")
        own = own.join(idf.withColumnRenamed("tok", c), c, "left").crossJoin(F.broadcast(most))  # one row
        per = own.groupBy("s1", "t").agg(
            F.count("*").alias(f"{prefix}_true_{kind}"), F.round(F.max(F.coalesce("idf", "top")), 6).alias(f"{prefix}_true_{kind}_max"), *([F.sort_array(F.collect_list(c)).alias("_true")] if kind == "extra" else [])
        )
        out = out.join(per, ["s1", "t"], "left")
    # how many other candidates of the s1 have the same true extra token
    extra = out.select("s1", "t", F.explode("_true").alias("tok"))
    others = extra.withColumn("n", F.count("*").over(Window.partitionBy("s1", "tok")) - 1).groupBy("s1", "t").agg(F.max("n").alias("g_extra_support"))
    return out.drop("_true").fillna(0).join(others, ["s1", "t"], "left").fillna(-1, ["g_extra_support"])


def number_features(joined: DataFrame) -> DataFrame:
    """How house numbers and address numbers of a pair differ; -1 where a side has none."""
    nums = lambda p: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(f"{p}_addr_norm", F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda v: F.ltrim(v, F.lit("0"))), lambda v: v != ""))
    both, n, m = sim.set_counts(nums("q"), nums("t"))
    a, b = F.col("q_house"), F.col("t_house")
    known = a.isNotNull() & b.isNotNull()
    digits = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    flag = lambda cond: F.when(~known, -1).otherwise(((a != b) & cond).cast("int"))
    either = lambda c: F.when((n == 0) | (m == 0), -1.0).otherwise(F.round(both / c, 6))
    return joined.select(
        "s1", "t", either(n + m - both).alias("num_jac"), F.round(sim.share(both, n), 6).alias("num_q_in_t"), F.round(sim.share(both, m), 6).alias("num_t_in_q"),
        F.when(a.isNull() | (m == 0), -1).otherwise(F.array_contains(nums("t"), a).cast("int")).alias("hs_in_t"),
        flag(a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)).alias("h_prefix"), flag(digits(a) == digits(b)).alias("h_sortdig_eq"),
        F.when(known, F.levenshtein(a, b)).otherwise(-1).alias("h_lev"),
        F.when(known, F.round(F.log1p(F.abs(F.try_to_number(a, F.lit("99999")) - F.try_to_number(b, F.lit("99999"))).cast("double")), 6)).otherwise(-1.0).alias("h_absdiff"),
        F.coalesce(F.length(a), F.lit(0)).alias("h_len_a"), F.coalesce(F.length(b), F.lit(0)).alias("h_len_b"),
    )


def support_features(joined: DataFrame) -> DataFrame:
    """Of joined pairs with a_tset: how many *other* candidates of the s1 share a candidate's core, house or address, and how their addresses fit."""
    good, bad = F.col("a_tset") >= 80, (F.col("a_tset") >= 0) & (F.col("a_tset") < 60)
    over = lambda c: Window.partitionBy("s1", c)
    others = lambda cond, c: F.sum(cond.cast("int")).over(over(c)) - cond.cast("int")
    core, address, whole = F.col("t_core") != "", F.col("t_addr_norm") != "", Window.partitionBy("s1")
    return joined.select(
        "s1", "t", F.when(core, F.count("*").over(over("t_core")) - 1).otherwise(0).alias("g_same_core"), F.when(core, others(good, "t_core")).otherwise(0).alias("g_same_core_goodaddr"), F.when(core, others(bad, "t_core")).otherwise(0).alias("g_same_core_badaddr"),
        F.when(F.col("t_house").isNotNull(), F.count("*").over(over("t_house")) - 1).otherwise(-1).alias("g_same_house"), F.when(address, F.count("*").over(over("t_addr_norm")) - 1).otherwise(-1).alias("g_same_addr"),
        F.count_if((F.col("t_core") == F.col("q_core")) & core).over(whole).alias("g_core_eq_q"), F.count_if(F.coalesce(F.col("t_house") == F.col("q_house"), F.lit(False))).over(whole).alias("g_house_eq_q"),
    )


def decoy_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The 35 features that tell near-duplicate negatives: numbers, IDF coverage, true extra and missing words, leave-one-out support, ranks."""
    joined = sides(pairs.select("s1", "t"), records, ("core", "addr_norm", "addr_tok", "house"))
    scored = with_similarities(joined, {"a_tset": ("tset", "q_addr_norm", "t_addr_norm", -1.0)})
    names = coverage(pairs, records, "core", "nm")
    places = coverage(pairs, records, "addr_tok", "ad").select("s1", "t", "ad_cov_q", "ad_cov_t", "ad_extra_idf", "ad_miss_idf")
    out = number_features(joined).join(names.drop("nm_extra", "nm_missing"), ["s1", "t"]).join(true_differences(names, records), ["s1", "t"]).join(places, ["s1", "t"]).join(support_features(scored), ["s1", "t"])
    w = Window.partitionBy("s1")
    return out.withColumns({
        "nm_cov_q_rank": F.rank().over(w.orderBy(F.desc("nm_cov_q"))), "nm_cov_q_gap": F.round(F.max("nm_cov_q").over(w) - F.col("nm_cov_q"), 6), "num_jac_rank": F.rank().over(w.orderBy(F.desc("num_jac"))),
    })


def competition(pairs: DataFrame, by: str = "p") -> DataFrame:
    """s1, t: best, sum and count of the *other* s1 that want the target, the target's second best, and the gap to the best other."""
    w = Window.partitionBy("t")
    ranked = pairs.withColumn("_k", F.row_number().over(w.orderBy(F.desc(by), "s1")))
    nth = lambda k: F.max(F.when(F.col("_k") == k, F.col(by))).over(w)
    other = F.coalesce(F.when(F.col("_k") == 1, nth(2)).otherwise(nth(1)), F.lit(0.0))
    return ranked.select(
        "s1", "t", other.alias("rev_max"), F.round(F.sum(by).over(w) - F.col(by), 6).alias("rev_sum"), (F.count("*").over(w) - 1).alias("rev_n"), F.coalesce(nth(2), F.lit(0.0)).alias("rev_second"), F.round(F.col(by) - other, 6).alias("rev_gap")
    )


def embedding_context(cosines: DataFrame) -> DataFrame:
    """Of s1, t, cos: rank and gap within the s1, and the target's best cosine with another s1 (null if there is none)."""
    w, v = Window.partitionBy("s1"), Window.partitionBy("t")
    ranked = cosines.withColumn("_k", F.row_number().over(v.orderBy(F.desc("cos"), "s1")))
    nth = lambda k: F.max(F.when(F.col("_k") == k, F.col("cos"))).over(v)
    return ranked.select(
        "s1", "t", F.col("cos").alias("e_cos"), F.rank().over(w.orderBy(F.desc("cos"))).alias("e_rank"), F.round(F.max("cos").over(w) - F.col("cos"), 6).alias("e_gap"), F.when(F.col("_k") == 1, nth(2)).otherwise(nth(1)).alias("e_best_other")
    )
