"""The pipeline's stages, each against brute force on its own input, and rows of every awkward kind."""

import pytest

import corpus_pipeline as cp
from joinery.llm import brute, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
AWKWARD = [(-1, None, "en", "x", None), (-2, "", "en", "x", 0), (-3, " \n ", None, None, 3), (-4, "one", "en", "x", 3), (-4, "one", "en", "x", 3), (None, "two words", "en", "x", 9), (-5, "long " * 30_000, "en", "x", 150_000)]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(AWKWARD, docs.schema)).withColumn("_marks", docs["text"]).withColumn("grade", docs["n_chars"])
    out, rows = {}, docs.select(*cp.COLUMNS).collect()
    frame = docs
    for name, stage in cp.STAGES:
        got = stage(spark, frame, SF).collect()
        out[name] = rows, got
        if name != "bpe":
            frame, rows = spark.createDataFrame(got, docs.select(*cp.COLUMNS).schema), got
    return out


def test_columns(stages):
    assert all(list(got[0].__fields__) == cp.COLUMNS for name, (_, got) in stages.items() if name != "bpe")


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.toxic}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id in keep)
    assert {r.doc_id for r in before if not (r.text or "").strip()} <= {r.doc_id for r in after}


def test_near_copies(stages):
    before, after = stages["near_duplicates"]
    want = brute.near([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id is None or want[r.doc_id][2])
    assert len(after) < len(before)


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    first = lambda d: float("-inf") if d is None else d
    want = brute.substrings(list({(first(r.doc_id), r.text) for r in before}))
    kept = {str((r.doc_id, r.text)): r for r in after}
    for r in before:
        n, gone, digest = want[first(r.doc_id)]
        if n and gone == n:
            continue
        mine = [x for x in after if x.doc_id == r.doc_id]
        assert mine and all(brute.sha(" ".join(brute.SPACED.findall(x.text or ""))) == digest for x in mine)
        if not gone:
            assert str((r.doc_id, r.text)) in kept
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not want[first(r.doc_id)][0] or want[first(r.doc_id)][1] < want[first(r.doc_id)][0]}
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None and r.doc_id is not None and r.doc_id >= 0)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.leaks([(str((r.doc_id, r.text)), r.text) for r in before], items)
    got = {}
    for r in after:
        got.setdefault(r.doc_id, []).append(r.text)
    for r in before:
        n, hit, *_ = want[str((r.doc_id, r.text))]
        if hit > 0.8 * n:
            assert r.doc_id not in got
        elif not hit:
            assert r.text in got[r.doc_id]
        else:
            assert all(len(brute.PLAIN.findall((x or "").translate(brute.LOWER))) <= n - hit + hit for x in got[r.doc_id]) and r.text not in got[r.doc_id]


def test_bpe(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["bpe"]
    want = []
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), *r[1:]) for r in after) == sorted(want)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "bpe"]


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert all(stage(spark, docs, SF).count() == 0 for _, stage in cp.STAGES)
