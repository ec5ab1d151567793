"""The same results in DuckDB SQL, as a chain of common table expressions that each oracle query ends."""

from __future__ import annotations

import string

from ..functions import vocabulary as v
from ..operators.decide import GRID
from ..operators.linkage import BITS, CHANNELS
from ..sources.records import BASE_SQL, RECORDS_SQL


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def _sub(c: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


def _clean(c: str) -> str:
    return f"trim({_sub(f'lower({c})', ('[^a-z0-9]+', ' '))})"


def _skeleton(c: str) -> str:
    repeats = [(f"{x}{x}+", x) for x in string.ascii_lowercase]
    return _sub(c, ("ph", "f"), ("ck", "k"), ("[cq]", "k"), ("z", "s"), (r"\B[aeiouh]", ""), *repeats)


def _folded(c: str) -> str:
    return _skeleton(_sub(c, ("bh", "v"), ("x", "ks"), ("j", "g"), (r"\By", "")))


def _drop(c: str, words) -> str:
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda t: t <> '' and t not in ({_list(words)})), ' ')"


#: Accents of the fixture are Latin ones.
NAME, ADDRESS = "lower(strip_accents(coalesce(business_name, '')))", "lower(strip_accents(coalesce(business_address, '')))"
SCRUB = _sub(NAME, (r"\(\s*id\s*:?\s*\d+\s*\)", " "), (v.WEB, " "), ("[&+]", " and "))
#: Skeletons of legal words, from the rules in SQL itself.
LEGAL_SKELETONS = f"(select list(distinct k) ks from (select {_skeleton('w')} k from (select unnest([{_list(v.LEGAL)}]) w)) where length(k) >= 3)"


def _skeletons(c: str) -> str:
    """Needs ``ks`` in scope."""
    return f"array_to_string(list_filter(string_split({_skeleton(c)}, ' '), lambda t: t <> '' and not list_contains(ks, t)), ' ')"


NUMS = r"list_filter(list_transform(regexp_extract_all({0}, '\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '' and length(x) <= 5)"


def _deleet(c: str, of: str = v.LEET_FROM, to: str = v.LEET_TO) -> str:
    letters, digits = "length(regexp_replace(t, '[^a-z]', '', 'g'))", "length(regexp_replace(t, '[^0-9]', '', 'g'))"
    return f"array_to_string(list_transform({_tokens(c)}, lambda t: case when {digits} > 0 and {letters} >= 2 and {letters} >= {digits} and not regexp_matches(t, '^[0-9]+(st|nd|rd|th)$') then translate(t, '{of}', '{to}') else t end), ' ')"


def _dedupe(c: str) -> str:
    """The first of equal tokens."""
    return f"array_to_string(list_transform(list_filter(list_zip({_tokens(c)}, range(1, len({_tokens(c)}) + 1)), lambda e: list_position({_tokens(c)}, e[1]) = e[2]), lambda e: e[1]), ' ')"


def derived(c: str) -> str:
    return _dedupe(_sub(_deleet(c, v.DIGIT_FROM, v.DIGIT_TO), (r"\b\d{7,}\b", " ")))


def _canonical_address(c: str) -> str:
    c = _sub(c, *[(a, b.replace("$", "\\")) for a, b in v.ADDR_RULES], *[(rf"\b{a}\b", b) for a, b in v.STATE_PHRASES.items()])
    names = v.STREET | v.STATE_WORDS
    table = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in names.items()) + "}"
    return f"array_to_string(list_transform(list_filter({_tokens(c)}, lambda t: t not in ({_list(v.ADDR_DROP)})), lambda t: coalesce({table}[t], t)), ' ')"


DELEET = _deleet("name_norm")

_weights = " union all ".join(f"select '{k}' kind, {w} weight, {c} cap, {1 << BITS[k]} bit" for k, (w, c) in v.KEYS.items())
_rescue = " union all ".join(f"select '{k}' kind, {w} weight, {c} cap, {1 << BITS[k]} bit" for k, (w, c) in v.RESCUE_KEYS.items())


def _rarest(view: str, p: str) -> str:
    return f"""{p}tok as (select distinct id, unnest({_tokens(view)}) tok from norm), {p}df as (select tok, count(*) df from {p}tok group by tok),
{p}rare as (select id, tok, row_number() over (partition by id order by df, tok) rn from {p}tok join {p}df using (tok)),
{p}wide as (select id, max(case when rn = 1 then tok end) {p}1, max(case when rn = 2 then tok end) {p}2, max(case when rn = 3 then tok end) {p}3 from {p}rare where rn <= 3 group by id)"""


_k = lambda kind, *parts: f"select id, src, '{kind}' kind, country || '|' || {' || '.join(f'{x} || {chr(39)}|{chr(39)}' for x in parts[:-1])}{' || ' if len(parts) > 1 else ''}{parts[-1]} as key from kb"
_keys = " union ".join([_k("A", "case when n2 is not null then least(n1, n2) end", "greatest(n1, n2)"), _k("B", "n1", "postcode"), _k("C", "n1", "a1"), _k("D", "case when length(concat) >= 4 then substr(concat, 1, 8) end"), _k("E", "n1"), _k("F", "postcode", "house"), _k("G", "a1", "house")])
_more = " union ".join([*(_k("H", f"case when {q} is not null then least({p}, {q}) end", f"greatest({p}, {q})") for p, q in (("a1", "a2"), ("a1", "a3"), ("a2", "a3"))), *(_k("I", n) for n in ("n1", "n2", "n3"))])


def _candidates(keys: str, types: str, p: str = "") -> str:
    return f"""{p}types as ({types}), {p}small as (select kind, key, max(weight) weight, max(bit) bit from {keys} join {p}types using (kind) where src > 1 group by kind, key having count(distinct id) <= max(cap)),
{p}hits as (select distinct a.id s1, b.id t, a.kind, weight, bit from {keys} a join {p}small using (kind, key) join {keys} b on b.kind = a.kind and b.key = a.key where a.src = 1 and b.src > 1),
{p}cand as (select * from (select s1, t, sum(weight) bscore, bit_or(bit) kmask, row_number() over (partition by s1 order by sum(weight) desc, t) rn from {p}hits group by s1, t) where rn <= 30)"""


def _grams(view: str) -> str:
    one = "flatten(list_transform([3, 4], lambda n: case when length(t) + 2 >= n then list_transform(range(1, length(t) + 4 - n), lambda i: substr(' ' || t || ' ', i, n)) else [' ' || t || ' '] end))"
    return f"list_distinct(flatten(list_transform({_tokens(view)}, lambda t: {one})))"


def _word_grams(view: str, sizes: tuple[int, ...]) -> str:
    t = _tokens(view)
    return f"list_distinct(flatten([{', '.join(f'list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], {chr(39)} {chr(39)}))' for n in sizes)}]))"


def channel_grams(name: str) -> str:
    view, char, sizes, _, _ = CHANNELS[name]
    return _grams(view) if char else _word_grams(view, sizes)


def cosine(grams: str, p: str, max_df: float, top: int, reverse: bool = False, table: str = "norm") -> str:
    q, t = ("src > 1", "src = 1") if reverse else ("src = 1", "src > 1")
    return f"""{p}post as (select id, src, country, unnest({grams}) g from {table}), {p}tot as (select country, count(distinct id) n from {p}post where src > 1 group by country),
{p}idf as (select country, g, 1 + ln((1 + max(n)) / (1 + count(*))) idf from {p}post join {p}tot using (country) where src > 1 group by country, g having count(*) <= max(n) * {max_df}),
{p}wt as (select id, src, country, g, idf from {p}post join {p}idf using (country, g)), {p}nrm as (select id, sqrt(sum(idf * idf)) nm from {p}wt group by id),
{p}unit as (select id, src, country, g, idf / nm w from {p}wt join {p}nrm using (id)),
{p}all as (select a.id q, b.id t, b.src tsrc, round(sum(a.w * b.w), 6) cos from (select * from {p}unit where {q}) a join (select * from {p}unit where {t}) b using (country, g) group by a.id, b.id, b.src),
{p}top as (select q, t, cos, rn from (select *, row_number() over (partition by q, tsrc order by cos desc, t) rn from {p}all) where rn <= {top})"""


CTES = [
    ("base", f"base as ({BASE_SQL})"),
    ("records", f"records as ({RECORDS_SQL})"),
    ("norm", rf"""norm0 as (select entity_id id, src, country, adr, {_clean(SCRUB)} name_norm, {_clean("adr")} addr_norm,
ltrim(nullif(regexp_extract(case when strpos(adr, ',') > 0 then substr(adr, strpos(adr, ',') + 1) end, '\b\d{{5,6}}\b'), ''), '0') postcode, {NUMS.format("adr")} nums from (select *, {ADDRESS} adr from records)),
norm1 as (select *, {_drop("name_norm", v.LEGAL)} core, array_to_string(list_filter(string_split(addr_norm, ' '), lambda t: regexp_matches(t, '^[a-z]{{3,}}$') and t not in ({_list(v.ADDR_STOP)})), ' ') addr_tok, case when nums[1] = postcode then nums[2] else nums[1] end house from norm0),
norm as (select id, src, country, name_norm, core, {_skeletons("core")} skel, replace(core, ' ', '') as concat, addr_norm, addr_tok, postcode, house from norm1, {LEGAL_SKELETONS})"""),
    ("kb", f"{_rarest('skel', 'n')}, {_rarest('addr_tok', 'a')}, kb as (select norm.*, n1, n2, n3, a1, a2, a3 from norm left join nwide using (id) left join awide using (id))"),
    ("keys", f"keys as (select * from ({_keys}) where key is not null)"),
    ("cand", _candidates("keys", _weights)),
    ("truth", "truth as (select a.entity_id s1, b.entity_id t from records a join records b on split_part(a.entity_id, '-', 2) = split_part(b.entity_id, '-', 2) where a.src = 1 and b.src > 1)"),
    ("scored", f"""scored as (select s1, t, a.country, round(0.05 + 0.45 * least(bscore, 12) / 12 + 0.5 * x / greatest(n + m - x, 1), 6) p from (select s1, t, bscore, q.country, len(list_intersect({_tokens("q.core")}, {_tokens("u.core")})) x, len(list_distinct({_tokens("q.core")})) n, len(list_distinct({_tokens("u.core")})) m
from cand join norm q on q.id = s1 join norm u on u.id = t) a)"""),
    ("owned", "owned as (select s1, t, p from (select *, row_number() over (partition by t order by p desc, s1) rn from scored) where rn = 1), matched as (select s1, t, p from (select *, row_number() over (partition by t order by p desc, s1) rn from scored where p >= 0.6) where rn = 1)"),
    ("perent", """ent as (select id s1, country from norm where src = 1), gold as (select s1, count(*) g from truth group by s1), chosen as (select s1, count(*) n from matched group by s1), right_ as (select s1, count(*) tp from matched join truth using (s1, t) group by s1),
reached as (select s1, count(*) r from cand join truth using (s1, t) group by s1),
perent as (select s1, country, coalesce(g, 0) g, coalesce(n, 0) n, coalesce(tp, 0) tp, coalesce(r, 0) r, case when coalesce(g, 0) = 0 and coalesce(n, 0) = 0 then 1.0 else cast(5 * coalesce(tp, 0) as double) / (4 * coalesce(n, 0) + coalesce(g, 0)) end f,
 case when coalesce(g, 0) = 0 then 1.0 else cast(5 * coalesce(r, 0) as double) / (4 * coalesce(r, 0) + coalesce(g, 0)) end u, case when coalesce(g, 0) = 0 then 1.0 else cast(5 * coalesce(tp, 0) as double) / (4 * coalesce(tp, 0) + coalesce(g, 0)) end c from ent left join gold using (s1) left join chosen using (s1) left join right_ using (s1) left join reached using (s1))"""),
]


def upto(name: str, *more: str) -> str:
    """The chain to ``name``, and further expressions."""
    out = []
    for n, text in CTES:
        out.append(text)
        if n == name:
            return "with " + ", ".join([*out, *more]) + " "
    raise KeyError(name)


def stable_mod(key: str, salt: str, k: int) -> str:
    """The first 8 bytes of SHA-256(salt + key), little-endian, modulo k."""
    h = f"sha256('{salt}' || {key})"
    return f"cast(list_sum(list_transform(range(0, 8), lambda i: cast('0x' || substr({h}, 2 * i + 1, 2) as hugeint) * cast(256 ** i as hugeint))) % {k} as int)"


GRID_SQL = ", ".join(str(x) for x in GRID)
RESCUE = f"rkeys as (select * from ({_keys} union {_more}) where key is not null), {_candidates('rkeys', _rescue, 'r')}"
CHAR_GRAMS = _grams("name_norm")
WORDS = f"list_distinct({_tokens('name_norm')})"
VIEWS = f"vnorm as (select *, {_folded('core')} name_fold, {_folded('addr_tok')} address_fold, core || ' ' || addr_norm combo from norm)"
_numeric = " union all ".join(f"select '{k}' kind, {w} weight, {c} cap, {1 << BITS[k]} bit" for k, (w, c) in v.NUMERIC_KEYS.items())
NUMERIC = "nkeys as (" + " union ".join(
    f"select id, src, '{k}' kind, country || '|' || num || '|' || tok as key from (select id, src, country, {n} num, unnest({_tokens(view)}) tok from norm where coalesce({n}, '') <> '') where length(tok) >= 2" for k, view, n in (("J", "skel", "house"), ("K", "addr_tok", "house"), ("L", "skel", "postcode"))
) + "), " + _candidates("nkeys", _numeric, "j")
#: The records in canonical form: names without aliases, with letters for digits; addresses in one form; house numbers without units.
CANONICAL = rf"""cn0 as (select entity_id id, src, country, adr, {_clean(SCRUB)} name_norm, {_canonical_address(_clean("adr"))} addr_norm,
ltrim(nullif(regexp_extract(case when strpos(adr, ',') > 0 then substr(adr, strpos(adr, ',') + 1) end, '\b\d{{5,6}}\b'), ''), '0') postcode, {NUMS.format(_sub("adr", (v.UNIT_NUMBER, " ")))} nums from (select *, {ADDRESS} adr from records)),
cn1 as (select *, {_drop(_deleet(_sub("name_norm", (v.ALIAS, ""))), v.LEGAL + v.HONORIFIC)} core0, array_to_string(list_filter(string_split(addr_norm, ' '), lambda t: regexp_matches(t, '^[a-z]{{3,}}$') and t not in ({_list(v.ADDR_STOP)})), ' ') addr_tok, case when nums[1] = postcode then nums[2] else nums[1] end house from cn0),
cn2 as (select *, {_dedupe("core0")} core from cn1), cnorm as (select *, {_skeletons("core")} skel, replace(core, ' ', '') as concat from cn2, {LEGAL_SKELETONS})"""
