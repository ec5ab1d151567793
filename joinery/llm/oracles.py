"""What the operators return, in DuckDB SQL over the whole tables, written from their contracts."""

from __future__ import annotations

SPACED, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def warc() -> str:
    """Digests in base 32: five bits at a time, out of two hexadecimal digits."""
    nibble = lambda i: f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"
    digit = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({nibble('5 * i // 4 + 1')} * 16 + {nibble('5 * i // 4 + 2')}) >> (3 - 5 * i % 4)) & 31) + 1, 1)"
    return f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages), f as (select *, min(page_id) over (partition by html) first from p)
select page_id, cast(octet_length(encode(html)) as bigint) payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {digit}), '') payload_digest,
 case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from f"""


def near(shingle: int = 2, percent: int = 80) -> str:
    """Pairs by the shingles that they share, and the least document that each can reach."""
    return f"""
with recursive t as (select doc_id, regexp_extract_all({LOWER}, '{SPACED}') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= {shingle} then list_transform(range(1, len(ws) - {shingle} + 2), lambda i: array_to_string(ws[i:i + {shingle - 1}], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] end) g from t),
n as (select doc_id, count(*) n from s group by doc_id), shared as (select g from s group by g having count(*) > 1), w as (select * from s semi join shared using (g)),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from w a join w b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= {percent} * (p.n + q.n - c)), ways as (select x, y from links union all select y, x from links),
reach as (select doc_id a, doc_id b from t union select r.a, ways.y from reach r join ways on ways.x = r.b)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from (select a doc_id, min(b) component_id from reach group by a) left join n using (doc_id)"""


def leaks(window: int = 10) -> str:
    """Windows of items, looked for at every place of every document."""
    runs = "unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {'i': i, 'g': array_to_string(ws[i:i + n - 1], ' ')}))"
    return f"""
with i as (select coalesce(cast(item_id as varchar), '') item, regexp_extract_all({LOWER}, '{PLAIN}') ws from benchmark),
g as (select distinct item, n, r.g from (select item, n, {runs} r from (select *, least({window}, len(ws)) n from i where len(ws) > 0))),
d as (select doc_id, regexp_extract_all({LOWER}, '{PLAIN}') ws from documents),
p as (select doc_id, n, r.i, r.g from (select doc_id, n, {runs} r from d, (select distinct n from g) where len(ws) >= n)),
f as (select distinct doc_id, p.n, p.i, item from p join g on g.n = p.n and g.g = p.g), h as (select doc_id, count(distinct k) c from (select doc_id, unnest(range(i, i + n)) k from f) group by doc_id),
m as (select doc_id, count(*) c, string_agg(item, ',' order by item) s from (select distinct doc_id, item from f) group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(h.c, 0) n_hit, coalesce(m.c, 0) n_items, sha256(coalesce(m.s, '')) items_sha256, h.c is not null contaminated from d left join h using (doc_id) left join m using (doc_id)"""


def substrings(window: int = 20) -> str:
    """Every window's first place; words of the others go."""
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') ws from documents),
p as (select doc_id, r.i, r.g from (select doc_id, unnest(list_transform(range(1, len(ws) - {window} + 2), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + {window - 1}], ' ')}})) r from d where len(ws) >= {window})),
o as (select doc_id, i, row_number() over (partition by g order by doc_id, i) > 1 again from p), gone as (select distinct doc_id, unnest(range(i, i + {window})) k from o where again),
l as (select doc_id, list(k) ks from gone group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(len(ks), 0) as bigint) n_removed, sha256(array_to_string(case when ks is null then ws else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda e: not list_contains(ks, e[2])), lambda e: e[1]) end, ' ')) kept_sha256 from d left join l using (doc_id)"""
