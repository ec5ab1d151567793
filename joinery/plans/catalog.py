"""Registered queries of the record-linkage operators, each beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as x
from ..functions import vocabulary as v
from ..operators import decide, evaluate, linkage
from ..sources import records as src
from ..sources import store
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _found[name] = f, oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import evaluation_queries, feature_queries  # noqa: F401 - they register themselves

    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _found.items() if s is not None}


def fresh(s: SparkSession, d: str) -> DataFrame:
    return linkage.normalise(src.fixture(s, d))


def norm(s: SparkSession, d: str) -> DataFrame:
    """The normalised records, written once: every plan reads them several times."""
    return store.cached(s, f"{d}/customer.parquet", {"normalise": 4}, lambda: fresh(s, d))


def names(s: SparkSession, d: str) -> DataFrame:
    """id, src, country and name_norm of the same, for plans that read no more: addresses and skeletons are not made."""
    return store.cached(s, f"{d}/customer.parquet", {"normalise": 4, "of": "name_norm"}, lambda: fresh(s, d).select("id", "src", "country", "name_norm"))


def entities(s: SparkSession, d: str) -> DataFrame:
    return norm(s, d).filter("src = 1").select(F.col("id").alias("s1"), "country")


def truth(s: SparkSession, d: str) -> DataFrame:
    return src.fixture_truth(src.fixture(s, d))


def cand(s: SparkSession, d: str) -> DataFrame:
    return linkage.candidates(linkage.blocking_keys(norm(s, d)))


def scored(s: SparkSession, d: str) -> DataFrame:
    """s1, t, country, p: half key score, half overlap of core names."""
    own = norm(s, d)
    side = lambda k: own.select(F.col("id").alias(k), F.col("core").alias(f"c{k}"), F.col("country").alias(f"k{k}"))
    pairs = cand(s, d).join(side("s1"), "s1").join(side("t"), "t")
    both, n, m = sim.set_counts(x.tokens(F.col("cs1")), x.tokens(F.col("ct")))
    p = F.round(0.05 + 0.45 * F.least("bscore", F.lit(12)) / 12 + 0.5 * both / F.greatest(n + m - both, F.lit(1)), 6)
    return pairs.select("s1", "t", F.col("ks1").alias("country"), p.alias("p"))


def matched(s: SparkSession, d: str) -> DataFrame:
    return decide.owners(scored(s, d), 0.6)


def per_entity(s: SparkSession, d: str) -> DataFrame:
    return decide.per_entity(entities(s, d), matched(s, d), truth(s, d)).join(entities(s, d), "s1")


_query("records", sql.upto("records") + "select * from records")(src.fixture)
_query("normalised", sql.upto("norm") + "select * from norm")(fresh)
_query("truth_pairs", sql.upto("truth") + "select * from truth")(truth)


@_query("row_ids", sql.upto("records") + "select *, row_number() over (order by src, entity_id) - 1 as row from records")
def _row_ids(s, d):
    return src.row_ids(src.fixture(s, d)).withColumn("row", F.col("row").cast("long"))


@_query("text_views", sql.upto("norm") + f"select id, {sql.DELEET} deleet, {sql._folded('core')} folded, array_to_string(list_sort({sql._tokens('name_norm')}), ' ') sorted_name, core || ' ' || addr_norm combo from norm")
def _views(s, d):
    return norm(s, d).select("id", x.deleet(F.col("name_norm")).alias("deleet"), x.folded(F.col("core")).alias("folded"), x.sorted_tokens(F.col("name_norm")).alias("sorted_name"), F.concat("core", F.lit(" "), "addr_norm").alias("combo"))


@_query("canonical_views", sql.upto("records", sql.CANONICAL) + f"select id, core, addr_norm address, {sql._deleet('name_norm', v.DIGIT_FROM, v.DIGIT_TO)} fixed from cnorm")
def _canonical(s, d):
    return norm(s, d).select("id", x.canonical_core(F.col("name_norm")).alias("core"), x.canonical_address(F.col("addr_norm")).alias("address"), x.deleet(F.col("name_norm"), v.DIGIT_FROM, v.DIGIT_TO).alias("fixed"))


@_query("stable_hash_mod", sql.upto("norm") + f"select id, {sql.stable_mod('id', 'fold', 5)} fold from norm")
def _stable(s, d):
    return norm(s, d).select("id", x.stable_mod(F.col("id"), "fold", 5).alias("fold"))


@_query("doc_freq", sql.upto("kb") + "select tok, df from ndf")
def _df(s, d):
    return linkage.document_frequency(norm(s, d), "skel")


@_query("rarest_tokens", sql.upto("kb") + "select id, n1 as r1, n2 as r2, n3 as r3 from nwide")
def _rare(s, d):
    return linkage.rarest(norm(s, d), "skel")


@_query("blocking_keys", sql.upto("keys") + "select * from keys")
def _keys(s, d):
    return linkage.blocking_keys(norm(s, d))


@_query("numeric_keys", sql.upto("norm", sql.NUMERIC) + "select distinct id, src, kind, key from nkeys")
def _numeric(s, d):
    return linkage.numeric_keys(norm(s, d))


@_query("block_sizes", sql.upto("keys") + "select kind, key, count(distinct id) n from keys where src > 1 group by kind, key")
def _sizes(s, d):
    return linkage.blocking_keys(norm(s, d)).filter("src > 1").groupBy("kind", "key").agg(F.count_distinct("id").alias("n"))


@_query("candidates_topk", sql.upto("cand") + "select s1, t, cast(bscore as bigint) bscore, cast(kmask as int) kmask from cand")
def _cand(s, d):
    return cand(s, d)


@_query("candidates_rescue", sql.upto("keys", sql.RESCUE) + "select s1, t, cast(bscore as bigint) bscore, cast(kmask as int) kmask from rcand")
def _cand_rescue(s, d):
    return linkage.candidates(linkage.blocking_keys(norm(s, d), rescue=True), v.RESCUE_KEYS)


@_query("blocking_report", sql.upto("truth", "ent as (select id s1, country from norm where src = 1)") + """select country, cast(sum(coalesce(l, 0)) as bigint) links, cast(sum(coalesce(f, 0)) as bigint) found, round(avg(coalesce(n, 0)), 6) pairs_per_entity, round(avg(case when n is null then 1 else 0 end), 6) none_share, quantile_cont(coalesce(n, 0), 0.95) pairs_p95
from ent left join (select s1, count(*) n from cand group by 1) using (s1) left join (select s1, count(*) l, count(c.t) f from truth left join cand c using (s1, t) group by 1) using (s1) group by country""")
def _report(s, d):
    return evaluate.blocking_report(entities(s, d), cand(s, d), truth(s, d))


@_query("missed_by_key", sql.upto("truth") + "select k.kind, count(distinct m.s1 || m.t) shared from (select s1, t from truth anti join cand using (s1, t)) m join keys k on k.id = m.s1 join keys u on u.id = m.t and u.kind = k.kind and u.key = k.key group by k.kind")
def _missed(s, d):
    keys = linkage.blocking_keys(norm(s, d))
    return evaluate.missed_by_key(truth(s, d), linkage.candidates(keys), keys)


@_query("idf_table", sql.upto("norm", sql.cosine(sql.WORDS, "w", 0.05, 5)) + "select country, g, round(idf, 6) idf from widf")
def _idf(s, d):
    return linkage.idf(linkage.grams(norm(s, d), "name_norm", False), 0.05).withColumn("idf", F.round("idf", 6))


@_query("cosine_topk_word", sql.upto("norm", sql.cosine(sql.WORDS, "w", 0.3, 5)) + "select * from wtop")
def _word(s, d):
    return linkage.cosine_top(norm(s, d), "name_norm", max_df=0.3)


@_query("cosine_topk_char", sql.upto("norm", sql.cosine(sql.CHAR_GRAMS, "c", 0.03, 5)) + "select * from ctop")
def _char(s, d):
    return linkage.cosine_top(norm(s, d), "name_norm", char=True, max_df=0.03)


@_query("channel_union", sql.upto("norm", sql.cosine(sql.WORDS, "w", 0.05, 5), sql.cosine(sql.CHAR_GRAMS, "c", 0.03, 5)) + "select coalesce(a.q, b.q) q, coalesce(a.t, b.t) t, coalesce(a.cos, 0.0) name_word, coalesce(b.cos, 0.0) name_char from wtop a full join ctop b on a.q = b.q and a.t = b.t")
def _channels(s, d):
    own = norm(s, d)
    return linkage.channel_union({"name_word": linkage.cosine_top(own, "name_norm", max_df=0.05, listed=True), "name_char": linkage.cosine_top(own, "name_norm", char=True, max_df=0.03, listed=True)})


@_query("reverse_best_other", sql.upto("norm", sql.cosine(sql.WORDS, "w", 0.3, 5, True)) + """select q, t, cos own, coalesce(case when r = 1 then s else f end, 0.0) other, round(cos - coalesce(case when r = 1 then s else f end, 0.0), 6) gap, k rnk, (select count(*) from wtop z where z.q = y.q and z.cos >= y.m - 0.05) - 1 n_close from
(select *, max(case when r = 1 then cos end) over (partition by q) f, max(case when r = 2 then cos end) over (partition by q) s, max(cos) over (partition by q) m from (select q, t, cos, row_number() over (partition by q order by cos desc, t) r, rank() over (partition by q order by cos desc) k from wtop)) y""")
def _reverse(s, d):
    return linkage.best_other(linkage.cosine_top(names(s, d), "name_norm", max_df=0.3, reverse=True))


@_query("reverse_features")
def _reverse_features(s, d):
    return linkage.reverse_features(cand(s, d), norm(s, d), "name_norm", max_df=0.3)


_TWO = "select s1, t, q.core qc, u.core tc, q.addr_norm qa, u.addr_norm ta, q.house qh, u.house th from cand join norm q on q.id = s1 join norm u on u.id = t"


def _pairs(s, d):
    own = norm(s, d)
    side = lambda k, p: own.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}{n}") for c, n in (("core", "c"), ("addr_norm", "a"), ("house", "h"))])
    return cand(s, d).select("s1", "t").join(side("s1", "q"), "s1").join(side("t", "t"), "t")


@_query("pair_similarity", sql.upto("cand") + f"""select s1, t, round(case when greatest(length(qc), length(tc)) = 0 then 1.0 else 1 - cast(levenshtein(qc, tc) as double) / greatest(length(qc), length(tc)) end, 6) lev,
round(case when len(x) = 0 and len(y) = 0 then -1.0 else cast(len(list_intersect(x, y)) as double) / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) jac, case when coalesce(qh, '') = '' or coalesce(th, '') = '' then -1 when qh = th then 1 else 0 end house_eq
from (select *, list_distinct({sql._tokens('qa')}) x, list_distinct({sql._tokens('ta')}) y from ({_TWO}))""")
def _similar(s, d):
    c = F.col
    return _pairs(s, d).select("s1", "t", F.round(sim.levenshtein_similarity(c("qc"), c("tc")), 6).alias("lev"), F.round(sim.jaccard(x.tokens(c("qa")), x.tokens(c("ta"))), 6).alias("jac"), sim.equal_flag(c("qh"), c("th")).alias("house_eq"))


@_query("jaro_winkler", sql.upto("cand") + f"select s1, t, round(jaro_winkler_similarity(qc, tc), 6) jw from ({_TWO})")
def _jw(s, d):
    return _pairs(s, d).select("s1", "t", F.round(sim.jaro_winkler("qc", "tc"), 6).alias("jw"))


@_query("fuzzy_ratios")
def _ratios(s, d):
    return _pairs(s, d).select("s1", "t", sim.ratio("qc", "tc").alias("ratio"), sim.partial_ratio("qc", "tc").alias("partial"), sim.token_sort_ratio("qc", "tc").alias("token_sort"), sim.token_set_ratio("qc", "tc").alias("token_set"))


@_query("embedding_cosine", "select a.vec_id a, b.vec_id b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) cos from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def _embedding(s, d):
    return linkage.label_cosines(s.read.parquet(f"{d}/embeddings.parquet"))


@_query("scored_pairs", sql.upto("scored") + "select * from scored")
def _scored(s, d):
    return scored(s, d)


@_query("context_gap_rank", sql.upto("scored") + "select s1, t, p, count(*) over w n_cand, round(max(p) over w - p, 6) p_gap, rank() over (partition by s1 order by p desc) p_rank from scored window w as (partition by s1)")
def _context(s, d):
    return decide.context(scored(s, d).select("s1", "t", "p"), "p")


@_query("anchor_support", sql.upto("scored") + "select a.s1, a.t, coalesce(max(b.p), -1.0) anc_best, count(b.t) anc_n from scored a left join (select * from (select *, row_number() over (partition by s1 order by p desc, t) rn from scored) where rn <= 3) b on a.s1 = b.s1 and a.t <> b.t group by a.s1, a.t")
def _anchors(s, d):
    return decide.anchors(scored(s, d).select("s1", "t", "p"))


@_query("neighbour_features", sql.upto("scored") + """select s1, t, pos, max(p) over w p_max, coalesce(max(case when pos = 1 then p end) over w, 0.0) p_2, coalesce(max(case when pos = 2 then p end) over w, 0.0) p_3, round(sum(p) over w, 6) p_sum, gap_next, gap_prev,
cast(sum(case when p >= 0.5 then 1 else 0 end) over w as bigint) n_p50, cast(sum(case when p >= 0.9 then 1 else 0 end) over w as bigint) n_p90 from (select *, row_number() over o - 1 pos, round(p - coalesce(lead(p) over o, 0.0), 6) gap_next, round(coalesce(lag(p) over o, 1.0) - p, 6) gap_prev from scored window o as (partition by s1 order by p desc, t)) window w as (partition by s1)""")
def _neighbours(s, d):
    return decide.neighbours(scored(s, d))


@_query("rivals", sql.upto("norm") + "select id t, case when n <= 20 then n end n_rivals, coalesce(n > 20, false) overflow from (select * from norm where src > 1 and length(name_norm) >= 5) left join (select country, name_norm, count(*) n from norm where src = 1 and length(name_norm) >= 5 group by 1, 2) using (country, name_norm)")
def _rivals(s, d):
    return linkage.rivals(norm(s, d))


@_query("survivor_cut", sql.upto("scored") + "select s1, t, p from (select *, row_number() over (partition by s1 order by p desc, t) rn from scored) where rn <= 5 and p >= 0.3")
def _survivors(s, d):
    return decide.survivors(scored(s, d).select("s1", "t", "p"), 5, 0.3)


@_query("unique_owner", sql.upto("owned") + "select s1, t, p from owned")
def _owner(s, d):
    return decide.owners(scored(s, d)).select("s1", "t", "p")


@_query("owners_with_ties", sql.upto("scored") + "select s1, t, p from (select *, max(p) over (partition by t) m from scored) where p = m")
def _ties(s, d):
    return decide.owners_with_ties(scored(s, d).select("s1", "t", "p"))


@_query("matches", sql.upto("owned") + "select s1, t, p from matched")
def _matches(s, d):
    return matched(s, d).select("s1", "t", "p")


@_query("logit_blend", sql.upto("scored") + "select s1, t, round(1 / (1 + exp(-(0.7 * ln(a / (1 - a)) + 0.3 * ln(b / (1 - b))))), 6) p from (select s1, t, greatest(least(p, 1 - 1e-6), 1e-6) a, greatest(least(p * p, 1 - 1e-6), 1e-6) b from scored)")
def _blend(s, d):
    return scored(s, d).select("s1", "t", F.round(decide.blend(F.col("p"), F.col("p") * F.col("p"), 0.3), 6).alias("p"))


@_query("expected_f_select")
def _expected(s, d):
    return decide.expected_f(scored(s, d).select("s1", "t", "p"))


@_query("per_entity_f05", sql.upto("perent") + "select s1, country, g, n, tp, round(f, 6) f from perent")
def _entity(s, d):
    return per_entity(s, d).withColumn("f", F.round("f", 6))


@_query("macro_f05_by_country", sql.upto("perent") + "select country, count(*) entities, round(avg(f), 6) macro_f from perent group by country")
def _macro(s, d):
    return per_entity(s, d).groupBy("country").agg(F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f"))


@_query("oracle_u", sql.upto("perent") + "select round(avg(u), 6) oracle_u from perent")
def _oracle(s, d):
    return decide.oracle(entities(s, d), cand(s, d), truth(s, d)).agg(F.round(F.avg("f"), 6).alias("oracle_u"))


@_query("threshold_sweep", sql.upto("perent", f"grid as (select unnest([{sql.GRID_SQL}]) theta)") + """select cast(theta as double) theta, round(avg(case when g = 0 and n = 0 then 1.0 else cast(5 * tp as double) / (4 * n + g) end), 6) macro_f from (select theta, e.s1, e.g, count(case when o.p >= theta then 1 end) n, count(case when o.p >= theta and u.t is not null then 1 end) tp
from grid cross join perent e left join owned o on o.s1 = e.s1 left join truth u on u.s1 = o.s1 and u.t = o.t group by theta, e.s1, e.g) group by theta""")
def _sweep(s, d):
    return decide.sweep(entities(s, d), scored(s, d), truth(s, d))


@_query("loss_decomposition", sql.upto("perent") + "select s1, round(1 - u, 6) retrieval, round(u - c, 6) missed, round(c - f, 6) false_positive, round(f, 6) f from perent")
def _losses(s, d):
    return decide.losses(entities(s, d), matched(s, d), cand(s, d), truth(s, d))


@_query("slice_grouping_sets", sql.upto("perent") + "select cast(grouping(country, g) as int) as level, country, g, count(*) entities, round(avg(f), 6) macro_f from perent group by grouping sets ((), (country), (g), (country, g))")
def _slices(s, d):
    return decide.slices(per_entity(s, d))


@_query("bootstrap_interval")
def _bootstrap(s, d):
    return decide.bootstrap(per_entity(s, d))


@_query("matching_lists", sql.upto("owned") + "select id source1_entity_id, coalesce(string_agg(t, ',' order by t), '') matched_entity_ids from norm left join matched on s1 = id where src = 1 group by id")
def _lists(s, d):
    return src.matching_lists(src.fixture(s, d).filter("src = 1"), matched(s, d))


@_query("transliteration", sql.upto("owned", f"""tk as (select distinct id, unnest({sql._tokens('core')}) tok from norm), pa as (select s1, t, tok from matched join tk on id = s1), pb as (select s1, t, tok from matched join tk on id = t),
mi as (select * from pa except select * from pb), ex as (select * from pb except select * from pa)""") + """select x, y, n from (select *, row_number() over (partition by x order by n desc, y) rn from (select ex.tok x, mi.tok y, count(*) n, max(nx) nx, max(ny) ny from ex join mi using (s1, t)
join (select tok, count(*) nx from ex group by 1) a on a.tok = ex.tok join (select tok, count(*) ny from mi group by 1) b on b.tok = mi.tok group by 1, 2) where n >= 3 and n >= 0.2 * (nx + ny - n)) where rn = 1""")
def _translit(s, d):
    return linkage.learn_transliteration(store.written(matched(s, d), "matched"), norm(s, d))


@_query("transliteration_applied")
def _applied(s, d):
    own = norm(s, d)
    return linkage.apply_dictionary(own, linkage.learn_transliteration(store.written(matched(s, d), "matched"), own))


@_query("violations")
def _violations(s, d):
    records = src.fixture(s, d)
    lists = src.matching_lists(records.filter("src = 1"), matched(s, d))
    could = src.matching_lists(records.filter("src = 1"), cand(s, d)).withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
    return decide.violations(records.filter("src = 1"), records.filter("src > 1"), lists, could)


@_query("sole_finder", sql.upto("cand") + "select kind, cast(count(*) as bigint) n from (select s1, t, min(kind) kind from (select distinct s1, t, kind from hits) group by s1, t having count(*) = 1) group by kind")
def _sole(s, d):
    keys = linkage.blocking_keys(norm(s, d))
    hits = keys.filter("src = 1").select(F.col("id").alias("s1"), "kind", "key").join(linkage.capped(keys), ["kind", "key"]).select("s1", "t", "kind").distinct()
    return hits.groupBy("s1", "t").agg(F.min("kind").alias("kind"), F.count("*").alias("c")).filter("c = 1").groupBy("kind").agg(F.count("*").alias("n"))


@_query("recall_at_k", sql.upto("truth", "ks as (select unnest([1, 3, 5, 10, 30]) k)") + "select k, count(*) found from ks join cand c on c.rn <= k join truth using (s1, t) group by k")
def _recall(s, d):
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("bscore"), "t"))
    own = cand(s, d).withColumn("rn", rank).join(truth(s, d), ["s1", "t"], "left_semi")
    return own.select(F.explode(F.filter(F.array(*map(F.lit, (1, 3, 5, 10, 30))), lambda k: k >= F.col("rn"))).alias("k")).groupBy("k").agg(F.count("*").alias("found"))
