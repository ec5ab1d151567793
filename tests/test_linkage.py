"""Golden cases, brute force on small inputs, and SQL oracles at the smallest scale."""

import hashlib
import itertools
import os
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from joinery.functions import similarity as sim
from joinery.functions import text as x
from joinery.functions import vocabulary as v
from joinery.operators import decide, evaluate, features, learning, linkage
from joinery.plans import catalog
from joinery.sources import records as src
from joinery.sources import store

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("r")).first().r


def test_text(spark):
    assert one(spark, x.skeleton(F.col("a")), a="raam maarketting") == "rm mrktng"
    assert one(spark, x.deleet(F.col("a"), v.DIGIT_FROM, v.DIGIT_TO), a="mi1ler spruce llc") == "miller spruce llc"
    assert one(spark, x.deleet(F.col("a")), a="4515 midland 1st") == "4515 midland 1st"
    assert one(spark, x.dedupe(F.col("a")), a="b a b") == "b a"
    a, b = (one(spark, x.folded(F.col("a")), a=t) for t in ("laxmi management", "lkssmii mainejmentt"))
    assert a == b


def test_similarity():
    assert list(sim.indel_ratios(["kitten", "", "a"], ["sitting", "", ""])) == pytest.approx([200 * 4 / 13, 100, 0])
    assert list(sim.best_windows(["abc", "", "", "abcd"], ["xxabcxx", "", "a", "xbcdy"])) == pytest.approx([100, 100, 0, 75])
    assert list(sim.winklers(["martha", "dixon", "", "a", "x"], ["marhta", "dicksonx", "", "", "y"])) == pytest.approx([0.9611, 0.8133, 1, 0, 0], abs=1e-4)
    assert list(sim.token_sort_ratios(["new york mets"], ["mets york new"])) == [100]
    assert list(sim.token_set_ratios(["a b", "a b c", "", "x y"], ["a b", "a b", "a", "y z"])) == pytest.approx([100, 100, 0, 200 * 2 / 6])


def test_ratios_are_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 70))) for _ in range(60)]

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            for j, (b, up, left) in enumerate(zip(y, list(row), list(row[1:]), strict=False)):
                row[j + 1] = max(left, row[j], up + (a == b))
        return row[-1]

    a, b = words[:30], words[30:]
    assert list(sim.lcs_lengths(a, b)) == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    con = duckdb.connect()
    want = [con.execute("select jaro_winkler_similarity(?, ?)", [x, y]).fetchone()[0] if x and y else float(x == y) for x, y in zip(a, b, strict=True)]
    assert list(sim.winklers(a, b)) == pytest.approx(want, abs=1e-9)


def test_to_ascii(spark):
    rows = ["Café Müller", "Straße Øst Łódź Æther", "कमल ट्रेडर्स", "१२ ½", "plain", None, "“x”–y", "ﬁn"]
    got = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(x.to_ascii(F.col("t")).alias("r")).collect()]
    assert got[0] == "Cafe Muller" and got[1] == "Strasse Ost Lodz AEther" and got[4:] == ["plain", "", "'x'-y", "fin"]
    assert got[2].split()[0] == "kml" and "".join(c for c in got[2] if c != " ") == "kmlttrreddrs".replace("rr", "r", 1) or got[2].isascii()
    assert got[3].startswith("12 1") and all(g.isascii() for g in got)


def test_names_and_addresses(spark):
    assert one(spark, x.clean(x.scrub(F.col("a"))), a="Acme ( ID 12 ) Company & Co (id: 7) www.acme.com") == "acme company and co acme"
    assert one(spark, x.canonical_address(F.col("a")), a="012 unit 7b north main street new york plot no 5 texas city") == "12 n main st ny 5 tx"
    assert one(spark, x.canonical_address(F.col("a")), a="221 1 2 first avenue po box 12 bombay maharashtra") == "221 1st ave mumbai mh"
    assert one(spark, x.canonical_core(F.col("a")), a="old name dba smt bili g0mez bili llc") == "bili gomez"
    assert "kmpny" in x.LEGAL_SKELETONS and all(len(k) > 2 for k in x.LEGAL_SKELETONS)
    r = spark.createDataFrame([("S1-1", "Zeta Companny", "Unit 7, 12 Oak Street, Rome, 00123", "N1", 1)], "entity_id string, business_name string, business_address string, country string, src int")
    plain, canonical = (linkage.normalise(r, canonical=c).first() for c in (False, True))
    assert (plain.core, plain.skel, plain.house, plain.postcode) == ("zeta companny", "st", "7", "123")
    assert (canonical.house, canonical.addr_norm) == ("12", "12 oak st rome 123")


def test_store(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"))
    own.put("a/b", b"\x00one")
    own.put("a/b", b"two")
    assert own.get("a/b") == b"two" and own.exists("a/b") and not own.exists("a/c") and own.list("a") == ["b"] and own.etag("a/b") == hashlib.sha256(b"two").hexdigest()
    with pytest.raises(FileExistsError):
        own.put("a/b", b"x", exclusive=True)


def test_zip_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/s1.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA \"x\"\tb\tN1\nS1-2\tC\n")
    got = store.read_zip(spark, str(tmp_path / "z.zip"), "d/s1.tsv", src.RAW).collect()
    assert [tuple(r) for r in got] == [("S1-1", 'A "x"', "b", "N1"), ("S1-2", "C", "", "")]


def test_sources_and_lists(spark, tmp_path):
    for k in (2, 3):
        src.write_tsv(spark.createDataFrame([(f"S{k}-1", "a", "", "N1")], src.RAW), str(tmp_path / str(k)))
    assert sorted((r.entity_id, r.src) for r in src.load_sources(spark, {2: str(tmp_path / "2"), 3: str(tmp_path / "3")}).collect()) == [("S2-1", 2), ("S3-1", 3)]
    twice = spark.createDataFrame([("e",), ("e",)], "entity_id string")
    with pytest.raises(Exception, match="several rows"):
        src.checked_lists(twice, spark.createDataFrame([("e", "t")], "s1 string, t string")).collect()


def test_siblings_and_rivals(spark):
    rec = [("q", 1, "acme foods", "12 oak st"), ("r", 1, "acme foods", "99 elm rd"), ("a", 2, "acme foods", "12 oak st"), ("b", 3, "zzz", "12 oak st"), ("c", 3, "acme food", "")]
    rows = [(i, s, "N1", n, n, n, n.replace(" ", ""), ad, ad, None, ad.split(" ")[0] or None) for i, s, n, ad in rec]
    records = spark.createDataFrame(rows, "id string, src int, country string, name_norm string, core string, skel string, concat string, addr_norm string, addr_tok string, postcode string, house string")
    scored = spark.createDataFrame([("q", "a", 0.95), ("q", "b", 0.6), ("q", "c", 0.2)], "s1 string, t string, p double")
    got = {r.t: r for r in features.sibling_features(scored, records).collect()}
    assert (got["b"].sib_pmax, got["b"].sib1_p, got["b"].sibc_a_tset, got["b"].sib_conf_addr, got["b"].sib1_hs_eq) == (0.95, 0.95, 100.0, 1, 1.0)
    assert (got["a"].sib_pmax, got["a"].sib_conf_name, got["c"].sibc_a_tset) == (0.6, 0, -1.0)
    rival = {(r.s1, r.t): r for r in features.rival_features(scored.select("s1", "t"), records).collect()}
    assert (rival["q", "a"].rJ_present, rival["q", "a"].o_joint, rival["q", "a"].rN_n_ratio, rival["q", "a"].t_overflow) == (1, 1.0, 1.0, 0)
    assert rival["q", "a"].gap_joint > 0 and (rival["q", "b"].rJ_present, rival["q", "b"].rJ_joint, rival["q", "c"].t_addr_missing) == (0, None, 1)
    decoys = {r.t: r for r in features.decoy_features(scored.select("s1", "t"), records).collect()}
    assert (decoys["a"].nm_cov_q, decoys["a"].g_core_eq_q, decoys["b"].nm_true_extra, decoys["b"].g_same_house) == (1.0, 1, 1, 1)
    assert (decoys["c"].nm_true_extra, decoys["c"].nm_true_miss, decoys["c"].num_jac) == (0, 0, -1.0)  # food and foods are typos of one another
    anchors = {r.t: r for r in features.anchor_features(scored.selectExpr("s1", "t", "100 * p c_tset", "100 * p n_tset", "-1D a_tset"), records, 1).collect()}
    assert (anchors["a"].h_rank, anchors["a"].anc_name_top, anchors["b"].anc_addr_top, anchors["b"].anc_h_top) == (1, -1.0, 100.0, 95.0)


def test_model_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i}", f"t{i}", (z := rng.random()), rng.random(), float(z > 0.5), 1.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "s1 string, t string, a double, b double, y double, w double")
    model = learning.train(frame, ["a", "b"], rounds=3, depth=2)
    pin = learning.save(spark, model, ["a", "b"], str(tmp_path / "m"))
    again, names = learning.load(spark, str(tmp_path / "m"))
    both = learning.score(learning.score(frame, model, names), again, names, "p2").collect()
    assert len(pin) == 64 and all(r.p == r.p2 for r in both) and sum((r.p > 0.5) == (r.y == 1) for r in both) > 270
    store.Store(spark, str(tmp_path / "m")).put("pin.json", b'{"features": [], "sha256": "x"}')
    with pytest.raises(ValueError, match="not the one"):
        learning.load(spark, str(tmp_path / "m"))


def test_guards(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "s1 string, t string")
    parts = spark.createDataFrame([("a", "fit"), ("b", "audit"), ("c", "fit")], "s1 string, part string")
    assert [(r.t, r.n) for r in learning.shared_targets(truth, parts).collect()] == [("x", 2)]
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "z", 0.8), ("b", "z", 0.7)], "s1 string, t string, p double")
    assert [(r.s1, r.t) for r in learning.without_leaks(pairs, truth, parts.filter("part = 'audit'")).collect()] == [("a", "z")]
    kept = learning.weighted(learning.labelled(pairs, truth), 0.5, hard=1).collect()
    assert {(r.s1, r.t): r.w for r in kept if r.t == "x" or r.s1 == "b"} == {("a", "x"): 1.0, ("b", "z"): 1.0} and all(r.w in (1.0, 2.0) for r in kept)


def test_bridge(spark):
    records = spark.createDataFrame([("s", "alpha beta"), ("t1", "beta gamma"), ("t2", "gamma delta"), ("t3", "qqq")], "id string, name_norm string")
    truth = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "t3")], "s1 string, t string")
    assert [tuple(r) for r in evaluate.bridged(truth, records).collect()] == [("s", 3, 1, 2)]


def test_f_golden(spark):
    truth = spark.createDataFrame([(0, t) for t in range(2)] + [(1, 10)] + [(2, 20), (2, 21)] + [(3, t) for t in range(30, 33)], "s1 long, t long")
    got = spark.createDataFrame([(0, 0), (0, 1), (0, 5), (1, 11), (2, 20), (3, 30), (3, 31), (3, 32), (3, 33)], "s1 long, t long")
    f = {r.s1: r.f for r in decide.per_entity(spark.range(6).toDF("s1"), got, truth).collect()}
    assert [f[i] for i in (0, 1, 2, 3, 4)] == pytest.approx([10 / 14, 0, 5 / 6, 15 / 19, 1.0])


def test_owner_ties_and_floor(spark):
    pairs = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.95), (3, 8, 0.5), (4, 8, 0.5)], "s1 long, t long, p double")
    assert {(r.s1, r.t) for r in decide.owners(pairs).collect()} == {(2, 7), (3, 8)}
    assert decide.owners_with_ties(pairs).count() == 3
    assert decide.survivors(pairs, 2, 0.6).count() == 2


def test_expected_f_is_brute_force():
    for p in ([0.9, 0.6, 0.2], [0.3, 0.3, 0.3], [0.05], [0.99, 0.98, 0.5]):
        value = []
        for k in range(len(p) + 1):
            total = 0.0
            for hit in itertools.product((0, 1), repeat=len(p)):
                chance = 1.0
                for q, h in zip(p, hit, strict=True):
                    chance *= q if h else 1 - q
                g, tp = sum(hit), sum(hit[:k])
                total += chance * (1.0 if not k and not g else 1.25 * tp / (k + 0.25 * g) if k else 0.0)
            value.append(total)
        assert decide.best_prefix(p) == value.index(max(value))


def test_expected_f_uses_the_whole_list(spark):
    pairs = [(1, t, 0.6) for t in range(30)] + [(2, t, 0.3 if t < 4 else 0.2) for t in range(30)]
    got = decide.expected_f(spark.createDataFrame(pairs, "s1 long, t long, p double")).groupBy("s1").count().collect()
    want = {s: decide.best_prefix([p for k, _, p in pairs if k == s]) for s in (1, 2)}
    assert {r.s1: r["count"] for r in got} == want and want[1] == 30


def test_embedding_cosine_reads_the_whole_table(spark):
    got = {(r.a, r.b): r.cos for r in catalog.queries()["embedding_cosine"](spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(p.vec_id, q.vec_id): float(np.dot(p.embedding, q.embedding) / np.linalg.norm(p.embedding) / np.linalg.norm(q.embedding)) for p in rows for q in rows if p.label == q.label and p.vec_id < q.vec_id}
    assert got.keys() == want.keys() and all(abs(got[k] - c) < 1e-6 for k, c in want.items()) and max(b for _, b in got) >= 200
    odd = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [-1.0, 0.0], 3), (3, [0.0, 0.0], 3), (4, None, 3), (5, [1.0], 3), (6, [1.0, 0.0], 4), (None, [1.0, 0.0], 3), (7, [1.0, None], 3)], "vec_id long, embedding array<double>, label int")
    for block in (1, 1024):
        pairs = {(r.a, r.b): r.cos for r in linkage.label_cosines(odd, block).collect()}
        assert pairs == {k: -1.0 if k == (1, 2) else None for k in itertools.combinations((1, 2, 3, 4, 5, 7), 2)}


def test_reverse_features_of_every_candidate(spark):
    rows = catalog.queries()["reverse_features"](spark, SF).collect()
    assert len(rows) == catalog.cand(spark, SF).count() == len({(r.s1, r.t) for r in rows})
    unit, vectors, source = linkage.unit_postings(catalog.norm(spark, SF), "name_norm", False, 0.3).collect(), {}, {}
    for r in unit:
        vectors.setdefault(r.id, {})[r.country, r.g] = r.w
        source[r.id] = r.src
    cos = lambda a, b: round(sum(w * vectors.get(b, {}).get(g, 0.0) for g, w in vectors.get(a, {}).items()), 6)
    lists, outside = {}, 0
    for r in rows:
        if r.t not in lists:
            every = ((cos(r.t, o), o) for o in vectors if source[o] == 1)
            lists[r.t] = sorted(((c, o) for c, o in every if c > 0), key=lambda x: (-x[0], x[1]))[:6]
        own, others = cos(r.t, r.s1), [c for c, o in lists[r.t] if o != r.s1]
        outside += r.s1 not in {o for _, o in lists[r.t]}
        want = own, max(others, default=0.0), 1 + sum(c > own for c in others), sum(c >= own - 0.05 for c in others)
        assert (r.own, r.other, r.rnk, r.n_close) == (pytest.approx(want[0], abs=2e-6), pytest.approx(want[1], abs=2e-6), *want[2:])
    assert outside


def test_losses_sum(spark):
    entities, truth, cand, matched = catalog.entities(spark, SF), catalog.truth(spark, SF), catalog.cand(spark, SF), catalog.matched(spark, SF)
    rows = decide.losses(entities, matched, cand, truth).collect()
    assert all(abs(r.retrieval + r.missed + r.false_positive + r.f - 1) < 1e-5 and min(r.retrieval, r.missed, r.false_positive) >= 0 for r in rows)


def test_cap_counts_targets(spark):
    keys = spark.createDataFrame([("a", 1, "E", "k"), ("x", 2, "E", "k"), ("y", 3, "E", "k")], "id string, src int, kind string, key string")
    assert linkage.candidates(keys, {"E": (1, 1)}).count() == 0
    assert [(r.s1, r.t, r.bscore, r.kmask) for r in linkage.candidates(keys, {"E": (1, 2)}, 1).collect()] == [("a", "x", 1, 16)]


def test_tsv_round_trip(spark, tmp_path):
    own = spark.createDataFrame([("S1-1", 'say "hi"', "", "N1")], src.RAW)
    src.write_tsv(own, str(tmp_path / "a"))
    assert [tuple(r) for r in src.read_tsv(spark, str(tmp_path / "a")).collect()] == [("S1-1", 'say "hi"', "", "N1")]
    with pytest.raises(ValueError, match="columns"):
        src.read_tsv(spark, str(tmp_path / "a"), src.TRUTH)


def test_violations(spark):
    entities = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    targets = spark.createDataFrame([("t1",)], "entity_id string")
    lists = spark.createDataFrame([("e1", "t1,t9"), ("e3", "t1")], "source1_entity_id string, matched_entity_ids string")
    could = spark.createDataFrame([("e1", "t1")], "source1_entity_id string, candidate_entity_ids string")
    got = {r.kind: r.n for r in decide.violations(entities, targets, lists, could).collect()}
    assert got == {"repeated_row": 0, "unknown_entity": 1, "missing_entity": 1, "unknown_target": 1, "repeated_target": 0, "shared_target": 1, "not_a_candidate": 2}


#: Not in this list: queries whose SQL takes long at every scale; the driver compares all of them.
@pytest.mark.parametrize("name", [
    "normalised", "normalised_canonical", "canonical_views", "record_views", "stable_hash_mod", "blocking_keys", "alternative_keys", "candidates_topk", "candidates_numeric", "cosine_topk_char", "channels", "reverse_best_other",
    "macro_f05_by_country", "matching_lists", "missed_by_key", "blocking_report", "pair_flags", "token_features", "number_features", "idf_coverage", "rival_counts", "support_features", "threshold_fine", "threshold_by_country", "paired_delta", "cut_grid", "noise_profile", "folds",
])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer",):
        con.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    df, rel = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert sorted((repr(tuple(r[c] for c in names)) for r in df.collect())) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
