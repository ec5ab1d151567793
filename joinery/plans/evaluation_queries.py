"""Registered queries of evaluation, guards, samples and learning, each beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, evaluate, features, learning
from ..sources import store
from . import sql
from .catalog import _query, cand, entities, matched, norm, per_entity, scored, truth

_ENT = "ent0 as (select id s1, country from norm where src = 1)"


def _f(n: str, tp: str, g: str) -> str:
    return f"case when {g} = 0 and {n} = 0 then 1.0 else cast(5 * {tp} as double) / (4 * {n} + {g}) end"


def _sweep(grid: str) -> str:
    return f"""select s1, e.country, theta, coalesce(e.g, 0) g, count(case when o.p >= theta then 1 end) n, count(case when o.p >= theta and u.t is not null then 1 end) tp
from ({grid}) cross join perent e left join owned o using (s1) left join truth u using (s1, t) group by s1, e.country, theta, e.g"""


@_query("threshold_fine", sql.upto("perent", f"rough as (select theta, round(avg({_f('n', 'tp', 'g')}), 6) m from ({_sweep(f'select unnest([{', '.join(map(str, evaluate.COARSE))}]) theta')}) group by theta)",
        "top as (select theta t0 from rough order by m desc, theta limit 1)",
        f"fine as (select theta, round(avg({_f('n', 'tp', 'g')}), 6) macro_f from ({_sweep('select distinct round(t0 + 0.0025 * i, 4) theta from top, (select unnest(range(-8, 9)) i) where t0 + 0.0025 * i between 0.05 and 0.995')}) group by theta)")
        + "select cast(theta as double) theta, macro_f, (row_number() over (order by macro_f desc, theta)) = 1 as best from fine")
def _fine(s, d):
    return evaluate.fine_sweep(entities(s, d), store.written(scored(s, d), "scored"), truth(s, d))


_SLICE = f"per as ({_sweep(f'select unnest([{sql.GRID_SQL}]) theta')}), bests as (select * from (select country, theta, macro_f, row_number() over (partition by country order by macro_f desc, theta) rn from (select country, cast(theta as double) theta, round(avg({_f('n', 'tp', 'g')}), 6) macro_f from per group by country, theta)) where rn = 1)"


@_query("threshold_by_country", sql.upto("perent", _SLICE) + "select country, theta, macro_f from bests")
def _by_country(s, d):
    return evaluate.sweep_by_slice(entities(s, d), scored(s, d), truth(s, d))


@_query("decided_by_country", sql.upto("perent", _SLICE) + "select s1, t, p from (select s1, t, p, row_number() over (partition by t order by p desc, s1) rn from scored join bests using (country) where p >= theta) where rn = 1")
def _decided(s, d):
    pairs = store.written(scored(s, d), "scored")
    return evaluate.decided_by_slice(pairs, evaluate.sweep_by_slice(entities(s, d), pairs, truth(s, d))).select("s1", "t", "p")


def _two(s, d):
    pairs, own, true = store.written(scored(s, d), "scored"), entities(s, d), truth(s, d)
    each = [decide.per_entity(own, decide.owners(pairs, theta), true) for theta in (0.6, 0.8)]
    return evaluate.paired_delta(*each, own)


_DELTA = """strict as (select s1, t from (select s1, t, row_number() over (partition by t order by p desc, s1) rn from scored where p >= 0.8) where rn = 1),
other as (select e.s1, e.country, e.f fa, case when e.g = 0 and coalesce(n2, 0) = 0 then 1.0 else cast(5 * coalesce(tp2, 0) as double) / (4 * coalesce(n2, 0) + e.g) end fb from perent e left join (select s1, count(*) n2 from strict group by 1) using (s1) left join (select s1, count(*) tp2 from strict join truth using (s1, t) group by 1) using (s1)),
delta as (select country, count(*) entities, round(avg(fa - fb), 6) mean, round(stddev_samp(fa - fb) / sqrt(count(*)), 6) se, count(case when fa > fb then 1 end) better, count(case when fa < fb then 1 end) worse from other group by rollup (country))"""


@_query("paired_delta", sql.upto("perent", _DELTA) + "select * from delta")
def _delta(s, d):
    return _two(s, d)


@_query("release_gate", sql.upto("perent", _DELTA) + "select bool_and(case when country is null then mean >= 0.0015 and mean - 1.645 * se > 0 when country = 'N0' then mean >= 0 else true end) passed from delta")
def _gate(s, d):
    return evaluate.gate(_two(s, d), slices=("N0",))


_CUTS = [(3, 0.0), (5, 0.3), (10, 0.3), (30, 0.001)]


@_query("cut_grid", sql.upto("scored", _ENT) + f"""select n, floor, cast(sum(c) as bigint) pairs, count(case when c > 0 then 1 end) entities, round(cast(sum(r) as double) / sum(g), 6) recall, round(avg(case when g = 0 then 1.0 else cast(5 * r as double) / (4 * r + g) end), 6) oracle_u from
(select x.n, cast(x.floor as double) floor, e.s1, count(case when rn <= x.n and p >= x.floor then 1 end) c, count(case when rn <= x.n and p >= x.floor then u.t end) r, coalesce(max(g), 0) g from (values {', '.join(f'({a}, {b})' for a, b in _CUTS)}) x(n, floor) cross join ent0 e
left join (select s1, t, p, row_number() over (partition by s1 order by p desc, t) rn from scored) k on k.s1 = e.s1 left join truth u on u.s1 = k.s1 and u.t = k.t left join (select s1, count(*) g from truth group by 1) gg on gg.s1 = e.s1 group by 1, 2, 3) group by n, floor""")
def _cuts(s, d):
    return evaluate.cut_grid(entities(s, d), scored(s, d), truth(s, d), _CUTS)


@_query("recall_by_country", sql.upto("truth", _ENT, "ks as (select unnest([1, 3, 10, 30]) k)") + "select country, k, count(u.t) found, count(*) pairs from ks join cand c on c.rn <= k join ent0 using (s1) left join truth u using (s1, t) group by country, k")
def _recall(s, d):
    return evaluate.recall_grid(cand(s, d), truth(s, d), entities(s, d), (1, 3, 10, 30))


_T = sql._tokens
_J = f"j as (select c.s1, c.t, c.p, q.name_norm qn, u.name_norm tn, q.addr_norm qa, u.addr_norm ta, q.house qh, u.house th, q.country, list_distinct({_T('q.core')}) qc, list_distinct({_T('u.core')}) tc from scored c join norm q on q.id = s1 join norm u on u.id = t)"


@_query("residuals", sql.upto("scored", _J) + """select kind, count(*) n, round(avg(cast(len(list_intersect(qc, tc)) = 0 as int)), 6) name_disjoint, round(avg(cast(qa = '' or ta = '' as int)), 6) addr_missing, round(avg(cast(coalesce(qh <> '' and th <> '' and qh <> th, false) as int)), 6) house_diff
from (select j.*, case when u.t is not null then case when p < 0.6 then 'rejected' else 'accepted' end else case when p >= 0.6 then 'false_pos' else 'negative' end end kind from j left join truth u using (s1, t)) group by kind""")
def _residuals(s, d):
    pairs = scored(s, d)
    return evaluate.residuals(pairs, truth(s, d), features.sides(pairs.select("s1", "t"), norm(s, d), ("core", "addr_norm", "house")), 0.6)


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) + 1, 2)), lambda i: substr(' ' || {0} || ' ', i, 3)))"
_SIG = f"""sig as (select *, tok or tri >= 0.25 as edge from (select s1, t, country, qn = tn name_exact, qa <> '' and qa = ta address_exact, ta = '' address_missing, len(list_intersect({_T('qn')}, {_T('tn')})) > 0 tok,
round(cast(len(list_intersect(x, y)) as double) / (len(x) + len(y) - len(list_intersect(x, y))), 6) tri, len(list_intersect({_T('qa')}, {_T('ta')})) > 0 address_token, len(a) > 0 and len(b) > 0 and len(list_intersect(a, b)) = 0 numbers_disjoint
from (select e.s1, e.t, q.country, q.name_norm qn, u.name_norm tn, q.addr_norm qa, u.addr_norm ta, {_TRI.format('q.name_norm')} x, {_TRI.format('u.name_norm')} y, list_distinct(regexp_extract_all(q.addr_norm, '\\d+')) a, list_distinct(regexp_extract_all(u.addr_norm, '\\d+')) b from truth e join norm q on q.id = s1 join norm u on u.id = t)))"""


def _signals(s, d):
    return evaluate.signals(features.sides(truth(s, d), norm(s, d), ("name_norm", "addr_norm", "country")))


@_query("noise_profile", sql.upto("truth", _SIG) + """select country, count(*) pairs, count(*) filter (name_exact) name_exact, count(*) filter (address_exact) address_exact, count(*) filter (address_missing) address_missing, count(*) filter (tok) name_token, count(*) filter (address_token) address_token,
count(*) filter (numbers_disjoint) numbers_disjoint, count(*) filter (edge) edge, count(*) filter (tri >= 0.5) trigram_050 from sig group by country""")
def _noise(s, d):
    return evaluate.noise_profile(_signals(s, d))


@_query("bridged_variants")
def _bridged(s, d):
    return evaluate.bridged(truth(s, d), norm(s, d))


@_query("score_histogram", sql.upto("scored") + "select cast(p > 0.2 as int) + cast(p > 0.4 as int) + cast(p > 0.6 as int) + cast(p > 0.8 as int) bin, count(*) n from scored group by 1")
def _histogram(s, d):
    return evaluate.histogram(scored(s, d), "p", [0.2, 0.4, 0.6, 0.8])


@_query("integrity", sql.upto("scored") + "select 's1' as column, count(*) - count(s1) nulls, 0::bigint not_finite from scored union all select 't', count(*) - count(t), 0 from scored union all select 'p', count(*) - count(p), count(case when not isfinite(p) then 1 end) from scored union all select '(keys)', count(*) - count(distinct s1 || '|' || t), 0 from scored")
def _integrity(s, d):
    return evaluate.integrity(scored(s, d).select("s1", "t", "p"), ["s1", "t"])


@_query("index_digest")
def _digest(s, d):
    return evaluate.digest(features.rival_keys(norm(s, d)).filter("src = 1"))


_PROFILE = "profile as (select country, count(*) entities, round(avg(coalesce(n, 0)), 6) mean_predicted, round(avg(case when n is null then 1 else 0 end), 6) empty, round(avg(case when n >= 8 then 1 else 0 end), 6) eight_plus from ent0 left join (select s1, count(*) n from matched group by 1) using (s1) group by country)"


@_query("output_profile", sql.upto("owned", _ENT, _PROFILE) + "select * from profile")
def _profile(s, d):
    return evaluate.output_profile(entities(s, d), matched(s, d))


_BANDS = {"mean_predicted": (1.14, 3.7), "empty": (0.0, 0.5)}


@_query("routed_output", sql.upto("owned", _ENT, _PROFILE, f"bad as (select country from profile where {' or '.join(f'{c} < {a} or {c} > {b}' for c, (a, b) in _BANDS.items())})") + """select s1, t from matched join ent0 using (s1) where country not in (select country from bad)
union all select s1, t from (select s1, t, country, row_number() over (partition by t order by p desc, s1) rn from scored where p >= 0.4) where rn = 1 and country in (select country from bad)""")
def _routed(s, d):
    return evaluate.routed(matched(s, d), decide.owners(scored(s, d), 0.4), evaluate.output_profile(entities(s, d), matched(s, d)), _BANDS)


@_query("coverage_ledger", sql.upto("cand", _ENT) + "select n, count(*) entities from (select s1, coalesce(c, 0) n from ent0 left join (select s1, count(*) c from cand group by 1) using (s1)) group by n")
def _ledger(s, d):
    return evaluate.ledger(entities(s, d), cand(s, d))


@_query("cut_conformance", sql.upto("scored", _ENT) + """select 'over_n' as rule, count(*) broken from (select s1 from scored group by s1 having count(*) > 20) union all select 'under_floor', count(*) from scored where p < 0.2
union all select 'repeated', count(*) from (select s1, t from scored group by s1, t having count(*) > 1) union all select 'two_countries', count(*) from (select t from scored s join ent0 e on e.s1 = s.s1 group by t having count(distinct e.country) > 1)""")
def _conformance(s, d):
    return evaluate.conformance(scored(s, d).select("s1", "t", "p"), 20, 0.2, entities(s, d))


@_query("covered_once", sql.upto("scored") + "select s1, t, cast(0 as bigint) as rows from scored where p < 0.3")
def _covered(s, d):
    own = scored(s, d).select("s1", "t", "p")
    return evaluate.covers_once(own, own.filter("p >= 0.3"))


@_query("splits", sql.upto("norm", _ENT) + f"select s1, case when h < 10 then 'audit' when h < 20 then 'validation' else 'fit' end part from (select s1, {sql.stable_mod('s1', 'split:', 100)} h from ent0)")
def _splits(s, d):
    return learning.split(entities(s, d))


@_query("folds", sql.upto("norm") + f"select s1, case when core <> '' then first_value(f) over (partition by same order by s1) else f end fold, {sql.stable_mod('s1', 'inner-fold:', 10)} = 0 as inner from (select id s1, core, coalesce(country, '') || '|' || core || '|' || addr_norm same, {sql.stable_mod('id', 'fold:', 5)} f from norm where src = 1)")
def _folds(s, d):
    return learning.folds(entities(s, d), norm(s, d))


@_query("seeded_sample", sql.upto("norm") + "select id s1 from norm where src = 1 order by sha256('order:' || id), id limit 100")
def _sample(s, d):
    return learning.sample(entities(s, d), 100)


@_query("modulus_sample", sql.upto("norm", _ENT) + f"select s1, country from ent0 where {sql.stable_mod('s1', 'sample:', 7)} = 0")
def _modulus(s, d):
    return learning.modulus_sample(entities(s, d), 7)


@_query("stratified_examples", sql.upto("perent") + "select s1, f, stratum from (select s1, round(f, 6) f, country || '|' || g stratum, row_number() over (partition by country || '|' || g order by s1) dd from perent) order by dd, stratum limit 50")
def _examples(s, d):
    own = per_entity(s, d).select("s1", F.round("f", 6).alias("f"), "country", "g")
    return learning.examples(own, F.concat("country", F.lit("|"), F.col("g").cast("string")), "s1", 50).select("s1", "f", "stratum")


_EASY = sql.stable_mod("s1 || '|' || t", "easy:", 1_000_000)


@_query("weighted_pairs", sql.upto("scored", "lab as (select s1, t, p, cast(u.t is not null as double) y, rank() over (partition by s1 order by p desc) r from scored left join (select s1, t from truth) u using (s1, t))") + f"select s1, t, p, y, case when y = 0 and r > 5 then 1 / 0.3 else 1.0 end w from lab where not (y = 0 and r > 5) or {_EASY} / 1000000 < 0.3")
def _weighted(s, d):
    return learning.weighted(learning.labelled(scored(s, d).select("s1", "t", "p"), truth(s, d)), 0.3, 5)


@_query("leak_guard", sql.upto("scored", f"held as (select id s1 from norm where src = 1 and {sql.stable_mod('id', 'split:', 100)} < 10)") + "select s1, t, p from scored anti join held using (s1) anti join (select t from truth semi join held using (s1)) using (t)")
def _guard(s, d):
    held = learning.split(entities(s, d)).filter("part = 'audit'")
    return learning.without_leaks(scored(s, d).select("s1", "t", "p"), truth(s, d), held)


@_query("shared_targets", sql.upto("scored", f"parts as (select id s1, case when h < 10 then 'audit' when h < 20 then 'validation' else 'fit' end part from (select id, {sql.stable_mod('id', 'split:', 100)} h from norm where src = 1))") + "select t, count(distinct part) n from scored join parts using (s1) group by t having count(distinct part) > 1")
def _shared(s, d):
    return learning.shared_targets(scored(s, d).select("s1", "t"), learning.split(entities(s, d)))


@_query("ensemble_mean", sql.upto("scored") + "select s1, t, round((p + round(p * p, 6)) / 2, 7) p from scored")
def _ensemble(s, d):
    own = scored(s, d).select("s1", "t", "p")
    return learning.ensemble([own, own.withColumn("p", F.round(F.col("p") * F.col("p"), 6))])


_CHEAP = ["bscore", "n_cand", "bscore_gap", "bscore_rank", "n_exact", "c_exact", "pc_eq", "hs_eq", "ntok_r", *[f"k{k}" for k in "ABCDEFG"]]


def _cheap(s, d):
    own = decide.context(features.flags(features.sides(cand(s, d), norm(s, d))), "bscore")
    return learning.labelled(own.select("s1", "t", *_CHEAP), truth(s, d))


@_query("learned_scores")
def _learned(s, d):
    """Out-of-fold scores of boosted trees on cheap features, two folds."""
    own = _cheap(s, d).join(learning.folds(entities(s, d), norm(s, d), 2), "s1").withColumn("w", F.lit(1.0))
    return learning.out_of_fold(store.written(own, "pairs"), _CHEAP, 2, rounds=10, depth=4).select("s1", "t", "y", "p")


@_query("learned_shortlist")
def _shortlist(s, d):
    """The 10 best candidates of each entity by a model of the fit part."""
    own = store.written(_cheap(s, d).join(learning.split(entities(s, d)), "s1").withColumn("w", F.lit(1.0)), "pairs")
    model = learning.train(own.filter("part = 'fit'"), _CHEAP, rounds=10, depth=4)
    return decide.survivors(learning.score(own.select("s1", "t", *_CHEAP), model, _CHEAP).select("s1", "t", "p"), 10, 0.0)
