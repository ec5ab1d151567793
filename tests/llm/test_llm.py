"""The ten operators against brute force, exact round trips and held-out accuracy; nulls, empties, ties, clashing columns."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from joinery.llm import ann, bpe, brute, common, html, leaks, licenses, nearcopies, substrings, tokenfiles, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, _marks string, n long, key string"


def docs(spark, rows):
    """With extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "m", 1, "k") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([8, 30, 90, 200]))] for _ in range(8)]
    out = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two"), (7, "x " * 3000)]
    for i in range(8, 120):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(own) // 9))):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 300)}"
        out.append((i, " ".join(own) + rng.choice(["", "\n" + " ".join(rng.choice(base)[:25])])))
    return out


def test_near(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.groups(docs(spark, rows), 2).collect()}
    assert got == brute.near(rows, 2)
    twice = nearcopies.groups(docs(spark, [(None, "a b"), (3, "a b"), (3, "c d"), (9, "c d")]), 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in twice) == [("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", True)]
    assert nearcopies.groups(docs(spark, [])).count() == 0


def test_near_in_blocks(spark, rows, monkeypatch):
    """Cells dealt into blocks, and pairs met in several batches."""
    for name, least in (("CELL_SETS", 3), ("CELL_SHINGLES", 600), ("OFTEN", 4), ("PAIRS", 5)):
        monkeypatch.setattr(nearcopies, name, least)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.groups(docs(spark, rows), 2).collect()}
    assert got == brute.near(rows, 2)


def test_cells():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 40, 7]
    cell = np.repeat(np.arange(4), sizes)
    t = pa.table({"leader": cell, "cell": np.zeros(50, int), "block": np.zeros(50, int), "rep": np.arange(50), "key": np.arange(50)})
    has = rng.random((50, 300)) < rng.choice([0.02, 0.2, 0.9], 300)
    row, value = np.nonzero(has)
    cells = nearcopies.Cells(t, has.sum(1))
    a, b, both = cells.overlaps(row, value.astype(np.uint64))
    shared = has.astype(int) @ has.T.astype(int)
    assert {(x, y): n for x, y, n in zip(a, b, both)} == {(x, y): shared[x, y] for x in range(50) for y in range(x + 1, 50) if cell[x] == cell[y] and shared[x, y]}
    assert list(cells.forest(np.array([3, 9, 4]), np.array([4, 10, 5]))[0]) == [4, 5, 10]
    assert {(x, y) for p, q in cells.pairs(0) for x, y in zip(p, q)} == {(x, y) for x in range(50) for y in range(x + 1, 50) if cell[x] == cell[y]}
    assert not len(cells.overlaps(row[:0], value[:0].astype(np.uint64))[0])


def test_substrings(spark, rows):
    got = {r.doc_id: tuple(r[1:]) for r in substrings.digests(docs(spark, rows)).collect()}
    assert got == brute.substrings(rows)
    small = [(r.doc_id, r.n_removed) for r in substrings.dedup(docs(spark, rows), window=4, gram=2, group_size=5).collect()]
    assert dict(small) == {k: v[1] for k, v in brute.substrings(rows, 4).items()}
    assert substrings.digests(docs(spark, [])).count() == 0
    same = substrings.digests(docs(spark, [(5, "a " * 30), (5, "a " * 30)])).collect()
    assert same[0] == same[1]


def test_substrings_of_repeated_rows(spark):
    own = [" ".join(f"{k}{i}" for i in range(30)) for k in "abc"]
    rows = [(5, own[0]), (5, own[0]), (6, own[1]), (6, own[1]), (6, own[0]), (7, f"{own[0]} {own[2]}"), (None, own[2]), (None, own[2])]
    got = sorted(((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs(spark, rows).coalesce(1)).collect()))
    assert got == sorted([("5", 30, 0, own[0])] * 2 + [("6", 30, 0, own[1])] * 2 + [("6", 30, 30, ""), ("7", 60, 60, "")] + [("None", 30, 0, own[2])] * 2)
    two = corpus_pipeline.without_repeated_passages(spark, spark.createDataFrame([(5, own[0], "en", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1), "")
    assert [r.text for r in two.collect()] == [own[0]] * 2


@pytest.mark.parametrize("block", [10**6, 30])
def test_leaks(spark, rows, block):
    rng = random.Random(5)
    items = [(i, " ".join((rows[rng.randrange(8, 100)][1] or "").split()[3 : 3 + rng.choice([4, 12, 30])])) for i in range(20)] + [(20, None), (21, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(rows, items)
    got = {r.doc_id: r for r in leaks.find(docs(spark, rows), bench, block_words=block).collect()}
    assert all((r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), brute.sha(",".join(sorted(r["items"])))) == want[k][:4] for k, r in got.items())
    cleaned = {r.doc_id: r.text for r in leaks.clean(docs(spark, rows), bench).collect()}
    assert all(cleaned[k] == t for k, t in rows if k in cleaned and not want[k][4])
    assert not any(v[4] and v[1] <= 0.8 * v[0] and k not in cleaned for k, v in want.items())


def test_bpe_and_files(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    odd = [(1000 + i, t) for i, t in enumerate(["don't  stop\n\n it's 12½ ", " <|endoftext|> a", "émé中文 ", "a\tb  c", "internationalization" * 40])]
    own = rows + odd
    got = {r.doc_id: r for r in bpe.digests(docs(spark, own), TOKENIZER).collect()}
    files = sorted(tokenfiles.digests(docs(spark, own), TOKENIZER).collect(), key=lambda r: r.doc_id)
    start = 0
    for (i, t), f in zip(sorted(own), files, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[i]) == (i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
        assert tuple(f) == (i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += len(ids) + 1
    assert bpe.digests(docs(spark, []), TOKENIZER).count() == tokenfiles.digests(docs(spark, []), TOKENIZER).count() == 0


@pytest.mark.parametrize("ids", [[], [0] * 5000, [2**60, 5, 2**64 - 1, 0], list(range(3000)), [1]])
def test_simple8b(ids):
    own = np.array(ids, np.uint64)
    words, per_block, escapes = tokenfiles.pack(own)
    assert (tokenfiles.unpack(words, per_block, len(own), escapes) == own).all()
    assert (tokenfiles.from_file(tokenfiles.to_file(np.array([1]), np.array([False]), np.array([len(own)]), own))[3] == own).all()


def test_warc(spark):
    own = [(5, "u", None), (4, "ü v", ""), (9, None, "ab"), (7, "x", "ab"), (8, "y", "c" * 100_000), (None, "z", "ab")]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digests(spark.createDataFrame(own, "page_id long, url string, html string")).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [("4", 0, sha(""), "response", None), ("5", 0, sha(""), "revisit", 4), ("7", 2, sha("ab"), "response", None), ("8", 100_000, sha("c" * 100_000), "response", None), ("9", 2, sha("ab"), "revisit", 7), ("None", 2, sha("ab"), "revisit", 7)]
    assert got == want
    raw = warc.record(1, "u", b"hello", None, False) + warc.record(2, "v", b"", 1, True)
    assert [b for _, b in warc.records(io.BytesIO(raw), 7)] == [b"hello", b""]
    with pytest.raises((warc.BadRecord, zlib.error)):
        list(warc.records(io.BytesIO(raw[:-9])))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[40:60] = x[40]
    own = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 3), (None, [1.0] * 16)]
    frame = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    got = ann.every_hundredth(frame).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        hits += len(set(best.tolist()) & {m[1] for m in mine})
    assert hits >= 0.9 * 150 and ann.every_hundredth(frame.limit(0)).count() == 0


def test_licenses(spark):
    own = [(1, None), (2, "The GNU General Public License; gnu general public license MIT license cc by cc-by, CC.BY mit Apache License xmit license"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (4, "mit by cc license apache")]
    got = {r.doc_id: r for r in licenses.digests(docs(spark, own)).collect()}
    assert tuple(got[2])[1:7] == (22, 7, 1, 18, "apache,cc-by,gpl,mit", "apache,cc-by,gpl,mit")
    assert (got[3].n_base, got[3].labels, got[1].n_words, got[4].labels) == (0, "mit", 0, "")


def test_html(spark):
    rng = random.Random(99)
    pages = [html.training_page(rng) for _ in range(150)]
    got = html.main_text([s for s, _ in pages], html.models())
    assert sum(g == "\n".join(m) for g, (_, m) in zip(got, pages, strict=True)) >= 0.97 * len(pages)
    own = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a &amp; b<br>c<p> d\n e</article><footer>x</footer>"), (4, "u", "<" * 50)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    assert (text[1], text[2], text[3]) == ("", "", "a & b c\nd e")


def test_toxicity(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(frame, labels.filter("doc_id % 3 <> 0"))
    held = toxicity.score(frame.select("doc_id", "text"), model).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    right = sum(bool(r.y) == r.toxic for r in held)
    assert right >= 0.9 * len(held) and (np.diff(model.thresholds) > 0).all()
    none = toxicity.grades(docs(spark, [(1, "a"), (2, None)]), labels.limit(0)).collect()
    assert [r.toxic for r in none] == [False, False]


def test_html_reads_what_a_parser_reads():
    """The words of all runs of a page are those that Python's own parser gives outside silent elements."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.silent = [], 0

        def handle_starttag(self, tag, attrs):
            self.silent += tag in html.SILENT
            self.out.append("")

        def handle_endtag(self, tag):
            self.silent -= tag in html.SILENT and self.silent > 0

        def handle_data(self, data):
            if not self.silent:
                self.out.append(data)

    rng = random.Random(9)
    for _ in range(60):
        source, main = html.training_page(rng)
        plain = Plain()
        plain.feed(source)
        runs = [text for _, text, _ in html.parse(source).runs]
        assert "".join("".join(runs).split()) == "".join("".join(plain.out).split())
        assert all(m in runs for m in main)


def test_html_awkward(spark):
    body = lambda x: html.parse(f"<article>{x}</article>").runs
    said = lambda x: [t for _, t, _ in body(x)]
    assert said("<p>one</p><!--><p>two</p><!---><p>three</p><!-- <p>no</p> --!><p>four</p>") == ["one", "two", "three", "four"]
    assert said('<p>a<b title="x > y">c</b> <a href=\'">\'>d</a></p>') == ["ac d"] and said("<p>1 < 2 <3</p>") == ["1 < 2 <3"]
    assert said("<p>&#65;&#0000000000066;&#x43;&#99999999999;&#" + "9" * 5000 + ";&amp;</p>") == ["ABC\ufffd\ufffd&"]
    assert said('<p>in</p><p x="never closed><p>out</p>') == ["in"]
    began = __import__("time").time()
    for bad in ("<a " * 300_000 + '"', "<div>" * 100_000 + "x", "<ul><li>" * 60_000, "<p>" * 200_000, "<button><p>" * 50_000 + "<div></div>" * 50_000, "<!--" * 200_000, "&" * 500_000, "<p x='" * 200_000):
        html.parse(bad)
    assert __import__("time").time() - began < 60
    page = "<article><h1>Head line</h1><p>The text of it, which is long enough. It goes on.</p></article>"
    frame = spark.createDataFrame([(1, "u", page, "t", 1), (1, "u", page, "t", 1), (2, None, None, "t", 2), (3, "u", "", "t", 3), (4, "u", page + "<p>" + "long text, again. " * 100_000 + "</p>", "t", 4)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.digests(frame).collect())
    assert got[0] == got[1] and "which is long" in got[0][1] and got[2] == (2, "", 0) and got[3] == (3, "", 0) and got[0][2] == len(got[0][1])
    assert html.digests(frame.limit(0)).count() == 0


def test_warc_is_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    frame = frame.withColumn("path", frame["url"]).withColumn("record_type", frame["url"])
    rows = frame.select("page_id", "html").collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.html or "", r.page_id)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(r.page_id, len((r.html or "").encode()), sha(r.html or ""), "response" if first[r.html or ""] == r.page_id else "revisit", None if first[r.html or ""] == r.page_id else first[r.html or ""]) for r in rows]
    assert sorted(map(str, map(tuple, warc.digests(frame).collect()))) == sorted(map(str, want))
    assert warc.digests(frame.limit(0)).count() == 0


def test_neighbours_repeated_queries(spark):
    own = [(0, None, 1), (0, [2.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [5.0, 0.0], 1)]
    got = [(r.rank, r.vec_id, r.score) for r in ann.every_hundredth(spark.createDataFrame(own, "vec_id long, embedding array<double>, score int")).orderBy("rank").collect()]
    assert got == [(1, 1, pytest.approx(0.1)), (2, 1, pytest.approx(0.1)), (3, 2, 4.0)]  # the least of its valid vectors asks


def test_awkward_documents(spark):
    """Empty tables, very long texts, repeated rows, clashing columns."""
    long = "alpha beta gamma delta " * 60_000
    rows = [(1, long + "MIT license"), (1, long + "MIT license"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, 1, 2.0, False, "l") for i, t in rows], "doc_id long, text string, grade int, severity double, toxic boolean, labels string")
    got = sorted(map(tuple, licenses.digests(frame).collect()))
    assert got[0] == got[1] and got[0][1:7] == (240_002, 1, 240_000, 240_000, "mit", "mit") and licenses.digests(frame.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(frame, toxicity.train(frame, labels))
    assert scored.select("grade", "severity", "toxic").count() == 4 and scored.columns.count("grade") == 1
    assert toxicity.grades(frame.limit(0), labels).count() == 0
    bench = spark.createDataFrame([("a", long[:400])], "item_id string, text string")
    hit = sorted((r.doc_id, r.n_words, r.n_hit) for r in leaks.digests(frame, bench).collect())
    assert hit == [(1, 240_002, 240_000)] * 2 + [(2, 0, 0), (3, 0, 0)]
    assert leaks.digests(frame.limit(0), bench).count() == 0 and [r.n_hit for r in leaks.digests(frame, bench.limit(0)).collect()] == [0] * 4


def test_leaks_long_items_in_segments(spark, rows, monkeypatch):
    """An item of several segments counts once, and windows over their borders are found."""
    monkeypatch.setattr(leaks, "SEGMENT", 7)
    item = " ".join(f"q{i}" for i in range(60))
    texts = [(1, item), (2, " ".join(f"q{i}" for i in range(12, 23))), (3, "x " + " ".join(f"q{i}" for i in range(3, 12))), (4, "Q5 q6 q7")]
    bench = spark.createDataFrame([(1, item), (2, item), (3, "q5 Q6!")], "item_id long, text string")
    want = brute.leaks(texts, [(1, item), (2, item), (3, "q5 Q6!")])
    assert {r.doc_id: tuple(r[1:]) for r in leaks.digests(docs(spark, texts), bench).collect()} == want


@pytest.mark.parametrize("name", ["op3_warc", "op5_license_scan", "op6_near_duplicates", "op7_decontamination", "op9_substring_dedup"])
def test_sql(spark, name):
    import duckdb

    from joinery.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, sf)
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_other_tasks_drop_the_encoder():
    """Its tables stay for the next task that encodes, and not in workers that go on to other work."""
    tables = bpe.loaded("tables", TOKENIZER)
    assert list(common.tidy(iter, True)(iter([1]))) == [1]
    assert bpe.loaded("tables", TOKENIZER) is tables
    assert list(common.tidy(iter)(iter([1]))) == [1]
    assert bpe.loaded("tables", TOKENIZER) is not tables
