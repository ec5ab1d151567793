"""Registered queries of views, keys, retrieval channels and pair features, each beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import vocabulary as v
from ..operators import decide, features, linkage
from ..sources import records as src
from ..sources import store
from . import sql
from .catalog import _query, cand, norm, scored, truth

_T = sql._tokens
_SIDES = "j as (select c.s1, c.t, bscore, kmask, q.name_norm qn, u.name_norm tn, q.core qc, u.core tc, q.addr_norm qa, u.addr_norm ta, q.addr_tok qk, u.addr_tok tk, q.house qh, u.house th, q.postcode qp, u.postcode tp, q.country qy, u.country ty, u.src tsrc from cand c join norm q on q.id = s1 join norm u on u.id = t)"


def _joined(s, d):
    return features.sides(cand(s, d), norm(s, d))


def _eq(a: str, b: str) -> str:
    return f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then -1 when {a} = {b} then 1 else 0 end"


@_query("normalised_canonical", sql.upto("records", sql.CANONICAL) + "select id, src, country, name_norm, core, skel, concat, addr_norm, addr_tok, postcode, house from cnorm")
def _canonical(s, d):
    return linkage.normalise(src.fixture(s, d), canonical=True)


@_query("record_views", sql.upto("norm") + f"select id, '[COL] name [VAL] ' || name_norm || ' [COL] address [VAL] ' || addr_norm line, array_to_string(list_sort(string_split(coalesce(house, ''), '')), '') digits, {sql.derived('name_norm')} derived from norm")
def _views(s, d):
    return norm(s, d).select("id", x.serialised(F.col("name_norm"), F.col("addr_norm")).alias("line"), x.sorted_characters(F.coalesce("house", F.lit(""))).alias("digits"), x.derived_name(F.col("name_norm")).alias("derived"))


@_query("profiling_fold", sql.upto("records") + "select entity_id id, trim(regexp_replace(lower(strip_accents(business_name)), '[^a-z0-9]+', ' ', 'g')) folded from records")
def _folds(s, d):
    return src.fixture(s, d).select(F.col("entity_id").alias("id"), x.profiling_fold(F.col("business_name")).alias("folded"))


@_query("truth_exploded", sql.upto("truth") + "select s1, t from truth")
def _exploded(s, d):
    records = src.fixture(s, d)
    lists = src.matching_lists(records.filter("src = 1"), truth(s, d))
    return src.explode_truth(lists)


@_query("checked_lists", sql.upto("truth") + "select id source1_entity_id, coalesce(string_agg(t, ',' order by t), '') matched_entity_ids from norm left join truth on s1 = id where src = 1 group by id")
def _checked(s, d):
    own = truth(s, d)
    return src.checked_lists(src.fixture(s, d).filter("src = 1"), own.unionByName(own))


@_query("lists_by_score", sql.upto("scored") + "select id source1_entity_id, coalesce(string_agg(t, ',' order by p desc, t), '') matched_entity_ids from norm left join scored on s1 = id where src = 1 group by id")
def _by_score(s, d):
    return src.matching_lists(src.fixture(s, d).filter("src = 1"), scored(s, d), by="p")


@_query("catalog_of_country", sql.upto("norm") + "select id, src, country, name_norm, core, skel, concat, addr_norm, addr_tok, postcode, house from norm where country = 'N1'")
def _catalog(s, d):
    own = norm(s, d)
    path = store.scratch(s, "catalog")
    store.write_catalog(own, path, {"normalise": 4})
    again = store.write_catalog(own, path, {"normalise": 4})  # the same policy: not written again
    return store.read_catalog(s, path, again.schema, "N1").select(*own.columns)


@_query("rows_of_ids", sql.upto("norm") + "select id, core from norm where id in (select id from norm where src = 1 and house = '107')")
def _only(s, d):
    own = norm(s, d)
    return store.only_rows(own, own.filter("src = 1 and house = '107'")).select("id", "core")


@_query("saved_idf", sql.upto("norm", sql.cosine(sql.WORDS, "w", 0.05, 5)) + "select country, g, round(idf, 6) idf from widf")
def _saved(s, d):
    path = store.scratch(s, "idf")
    make = lambda: linkage.idf(linkage.grams(norm(s, d), "name_norm", False), 0.05)
    store.saved_idf(make, path, {"view": "name_norm", "max_df": 0.05}, s)
    return store.saved_idf(make, path, {"view": "name_norm", "max_df": 0.05}, s).withColumn("idf", F.round("idf", 6))


@_query("alternative_keys", sql.upto("kb", f"alt as (select *, list_filter(string_split(skel, ' '), lambda t: t <> '')[1] f, list_filter(string_split(addr_tok, ' '), lambda t: t <> '')[-1] l from kb)") + """select distinct id, src, kind, key from (
select id, src, 'H' kind, country || '|' || a1 || '|' || a2 as key from alt union all select id, src, 'I', country || '|' || nullif(postcode, '') || '|' || a1 from alt union all select id, src, 'J', country || '|' || a2 || '|' || nullif(house, '') from alt
union all select id, src, 'K', country || '|' || f || '|' || nullif(house, '') from alt where length(f) >= 2 union all select id, src, 'L', country || '|' || nullif(house, '') || '|' || substr(concat, 1, 1) || '|' || l from alt where length(l) >= 2 and length(concat) >= 1) where key is not null""")
def _alternative(s, d):
    return linkage.alternative_keys(norm(s, d))


@_query("candidates_numeric", sql.upto("norm", sql.NUMERIC) + "select s1, t, cast(bscore as bigint) bscore, cast(kmask as int) kmask from jcand")
def _numeric_candidates(s, d):
    return linkage.candidates(linkage.numeric_keys(norm(s, d)), v.NUMERIC_KEYS)


@_query("channels", sql.upto("norm", sql.VIEWS, *[sql.cosine(sql.channel_grams(n), f"{n}_", spec[3], spec[4], table="vnorm") for n, spec in linkage.CHANNELS.items()])
        + "select q, t, " + ", ".join(f"coalesce(max(case when c = '{n}' then cos end), 0.0) {n}" for n in linkage.CHANNELS) + " from (" + " union all ".join(f"select q, t, '{n}' c, cos from {n}_top" for n in linkage.CHANNELS) + ") group by q, t")
def _channels(s, d):
    return linkage.channels(norm(s, d))


@_query("pair_flags", sql.upto("cand", _SIDES) + f"""select s1, t, cast(qn = tn as int) n_exact, cast(qc = tc and qc <> '' as int) c_exact, {_eq('qp', 'tp')} pc_eq, {_eq('qh', 'th')} hs_eq, {_eq('qy', 'ty')} cty_eq, length(qn) n_len1, length(tn) n_len2, length(qa) a_len1, length(ta) a_len2,
round(cast(least(len(string_split(qn, ' ')), len(string_split(tn, ' '))) as double) / greatest(len(string_split(qn, ' ')), len(string_split(tn, ' '))), 6) ntok_r, tsrc src, {', '.join(f"cast((kmask >> {linkage.BITS[k]}) & 1 as int) k{k}" for k in 'ABCDEFG')},
count(*) over w n_cand, cast(max(bscore) over w - bscore as bigint) bscore_gap, rank() over (partition by s1 order by bscore desc) bscore_rank from j window w as (partition by s1)""")
def _flags(s, d):
    own = decide.context(features.flags(_joined(s, d)), "bscore")
    names = ["n_exact", "c_exact", "pc_eq", "hs_eq", "cty_eq", "n_len1", "n_len2", "a_len1", "a_len2", "ntok_r", "src", *[f"k{k}" for k in "ABCDEFG"], "n_cand"]
    return own.select("s1", "t", *names, F.col("bscore_gap").cast("bigint").alias("bscore_gap"), F.col("bscore_rank").cast("bigint").alias("bscore_rank"))


@_query("pair_features")
def _features(s, d):
    return features.pair_features(cand(s, d), norm(s, d))


_SHARE = "round(case when {1} > 0 then cast({0} as double) / {1} else -1.0 end, 6)"


@_query("token_features", sql.upto("cand", _SIDES) + f"""select s1, t, {_SHARE.format('i', 'm')} name_token_precision, {_SHARE.format('i', 'n')} name_token_recall, m - i name_extra_tokens, n - i name_missing_tokens, {_SHARE.format('k', '(a + b - k)')} number_jaccard, {_SHARE.format('k', 'b')} number_precision, {_SHARE.format('k', 'a')} number_recall,
cast(a = 0 or b = 0 as int) number_missing, cast(n = 0 or m = 0 as int) name_missing, cast(qa = '' or ta = '' as int) address_missing from (select *, len(x) n, len(y) m, len(list_intersect(x, y)) i, len(p) a, len(r) b, len(list_intersect(p, r)) k from
(select *, list_distinct({_T('qc')}) x, list_distinct({_T('tc')}) y, list_distinct(regexp_extract_all(qa, '\\d+')) p, list_distinct(regexp_extract_all(ta, '\\d+')) r from j))""")
def _tokens(s, d):
    return features.token_features(_joined(s, d))


@_query("folded_features")
def _folded(s, d):
    return features.folded_features(_joined(s, d))


@_query("text_rank")
def _text_rank(s, d):
    return features.text_rank(cand(s, d), norm(s, d))


@_query("label_free_cut", sql.upto("scored") + "select s1, t, p from (select s1, t, p, row_number() over (partition by s1 order by round(p + bscore, 6) desc, t) rn from scored join cand using (s1, t)) where rn <= 4")
def _label_free(s, d):
    own = scored(s, d).select("s1", "t", "p").join(cand(s, d).select("s1", "t", "bscore"), ["s1", "t"])
    return features.label_free_cut(own, ["p", "bscore"], 4).select("s1", "t", "p")


@_query("anchor_features")
def _anchors(s, d):
    own = features.sides(cand(s, d).select("s1", "t"), norm(s, d), ("name_norm", "core", "addr_norm"))
    specs = {"c_tset": ("tset", "core", None), "n_tset": ("tset", "name_norm", None), "a_tset": ("tset", "addr_norm", -1.0)}
    scored_ = features.with_similarities(own, features.of_views(specs)).select("s1", "t", *specs)
    return features.anchor_features(store.written(scored_, "pairs"), norm(s, d))


@_query("sibling_features")
def _siblings(s, d):
    return features.sibling_features(store.written(decide.survivors(scored(s, d), 10), "survivors"), norm(s, d))


_RK = " union ".join(f"select id, src, coalesce(country, '') || '|{n}|' || v as key from (select id, src, country, {e} v from norm) where length(v) >= 5" for n, e in (
    ("core", "core"), ("core_sorted", f"array_to_string(list_sort({_T('core')}), ' ')"), ("concat", "concat"), ("skel", "skel"), ("addr_norm", "addr_norm"),
    ("house_addr", "case when coalesce(house, '') <> '' and coalesce(addr_tok, '') <> '' then house || ' ' || addr_tok end")))


@_query("rival_counts", sql.upto("norm", f"rk as ({_RK}), rp as (select key, count(*) n from rk where src = 1 group by key)") + """select a.id t, count(*) n_keys, max(cast(coalesce(n, 0) > 20 as int)) overflow, coalesce(max(r.c), 0) n_rivals from rk a left join rp using (key)
left join (select a.id, count(distinct b.id) c from rk a join rp using (key) join rk b on b.key = a.key and b.src = 1 where a.src > 1 and n <= 20 group by a.id) r on r.id = a.id where a.src > 1 group by a.id""")
def _rival_counts(s, d):
    return features.rival_counts(norm(s, d))


@_query("rival_features")
def _rivals(s, d):
    return features.rival_features(store.written(cand(s, d), "pairs"), norm(s, d))


_IDF = "odf as (select tok, count(*) df from (select distinct id, unnest(" + _T("core") + ") tok from norm where src > 1) group by tok), oidf as (select tok, ln((select count(*) from norm where src > 1) + 1) - ln(df + 1) idf from odf)"


@_query("offset_idf", sql.upto("norm", _IDF) + "select tok, round(idf, 6) idf from oidf")
def _offset(s, d):
    return features.offset_idf(norm(s, d), "core").withColumn("idf", F.round("idf", 6))


@_query("idf_coverage", sql.upto("cand", _IDF, f"tk as (select distinct id, tok, coalesce(idf, (select max(idf) from oidf)) w from (select id, unnest({_T('core')}) tok from norm) left join oidf using (tok))",
        "pq as (select c.s1, c.t, tok, w from cand c join tk on id = s1), pt as (select c.s1, c.t, tok, w from cand c join tk on id = t)")
        + """select c.s1, c.t, round(case when q > 0 then coalesce(b, 0) / q else -1.0 end, 6) nm_cov_q, round(case when u > 0 then coalesce(b, 0) / u else -1.0 end, 6) nm_cov_t, round(coalesce(x, 0.0), 6) nm_extra_idf, round(coalesce(xm, 0.0), 6) nm_extra_max, round(coalesce(m, 0.0), 6) nm_miss_idf, round(coalesce(mm, 0.0), 6) nm_miss_max from cand c
left join (select s1, t, sum(w) q from pq group by 1, 2) using (s1, t) left join (select s1, t, sum(w) u from pt group by 1, 2) using (s1, t) left join (select s1, t, sum(w) b from pq semi join pt using (s1, t, tok) group by 1, 2) using (s1, t)
left join (select s1, t, sum(w) x, max(w) xm from pt anti join pq using (s1, t, tok) group by 1, 2) using (s1, t) left join (select s1, t, sum(w) m, max(w) mm from pq anti join pt using (s1, t, tok) group by 1, 2) using (s1, t)""")  # fmt: skip
def _coverage(s, d):
    return features.coverage(cand(s, d), norm(s, d), "core", "nm").drop("nm_extra", "nm_missing")


_N = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '\\d+'), lambda e: ltrim(e, '0')), lambda e: e <> ''))"


@_query("number_features", sql.upto("cand", _SIDES) + f"""select s1, t, round(case when n = 0 or m = 0 then -1.0 else cast(i as double) / (n + m - i) end, 6) num_jac, {_SHARE.format('i', 'n')} num_q_in_t, {_SHARE.format('i', 'm')} num_t_in_q, case when qh is null or m = 0 then -1 else cast(list_contains(y, qh) as int) end hs_in_t,
case when qh is null or th is null then -1 else cast(qh <> th and (starts_with(qh, th) or starts_with(th, qh) or suffix(qh, th) or suffix(th, qh)) as int) end h_prefix, case when qh is null or th is null then -1 else cast(qh <> th and list_sort(string_split(qh, '')) = list_sort(string_split(th, '')) as int) end h_sortdig_eq,
case when qh is null or th is null then -1 else levenshtein(qh, th) end h_lev, case when qh is null or th is null then -1.0 else round(ln(1 + abs(cast(qh as int) - cast(th as int))), 6) end h_absdiff, coalesce(length(qh), 0) h_len_a, coalesce(length(th), 0) h_len_b
from (select *, len(x) n, len(y) m, len(list_intersect(x, y)) i from (select *, {_N.format('qa')} x, {_N.format('ta')} y from j))""")
def _numbers(s, d):
    return features.number_features(_joined(s, d)).withColumn("h_lev", F.col("h_lev").cast("bigint"))


@_query("support_features", sql.upto("scored", _SIDES, "g as (select j.*, p from j join scored using (s1, t))") + """select s1, t, case when tc <> '' then count(*) over (partition by s1, tc) - 1 else 0 end g_same_core, case when tc <> '' then cast(sum(cast(100 * p >= 80 as int)) over (partition by s1, tc) - cast(100 * p >= 80 as int) as bigint) else 0 end g_same_core_goodaddr,
case when tc <> '' then cast(sum(cast(100 * p >= 0 and 100 * p < 60 as int)) over (partition by s1, tc) - cast(100 * p >= 0 and 100 * p < 60 as int) as bigint) else 0 end g_same_core_badaddr, case when th is not null then count(*) over (partition by s1, th) - 1 else -1 end g_same_house,
case when ta <> '' then count(*) over (partition by s1, ta) - 1 else -1 end g_same_addr, count(*) filter (tc = qc and tc <> '') over (partition by s1) g_core_eq_q, count(*) filter (coalesce(th = qh, false)) over (partition by s1) g_house_eq_q from g""")
def _support(s, d):
    """With 100 p in the place of the address ratio, which SQL has not."""
    joined = _joined(s, d).join(scored(s, d).select("s1", "t", (100 * F.col("p")).alias("a_tset")), ["s1", "t"])
    out = features.support_features(joined)
    return out.select("s1", "t", *[F.col(c).cast("bigint").alias(c) for c in out.columns[2:]])


@_query("decoy_features")
def _decoys(s, d):
    return features.decoy_features(store.written(cand(s, d), "pairs"), norm(s, d))


@_query("competition", sql.upto("scored") + """select s1, t, o rev_max, round(sum(p) over w - p, 6) rev_sum, count(*) over w - 1 rev_n, coalesce(b, 0.0) rev_second, round(p - o, 6) rev_gap from (select *, coalesce(case when k = 1 then b else a end, 0.0) o from
(select *, max(case when k = 1 then p end) over (partition by t) a, max(case when k = 2 then p end) over (partition by t) b from (select s1, t, p, row_number() over (partition by t order by p desc, s1) k from scored))) window w as (partition by t)""")
def _competition(s, d):
    return features.competition(scored(s, d).select("s1", "t", "p"))


@_query("embedding_context", sql.upto("scored") + """select s1, t, cos e_cos, rank() over (partition by s1 order by cos desc) e_rank, round(max(cos) over (partition by s1) - cos, 6) e_gap, case when k = 1 then b else a end e_best_other from
(select *, max(case when k = 1 then cos end) over (partition by t) a, max(case when k = 2 then cos end) over (partition by t) b from (select s1, t, p cos, row_number() over (partition by t order by p desc, s1) k from scored))""")
def _context(s, d):
    return features.embedding_context(scored(s, d).select("s1", "t", F.col("p").alias("cos")))
