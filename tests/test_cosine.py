"""Retrieval by cosine: blocks against brute force and SQL, and what is shuffled."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from joinery.operators import cosine, linkage
from joinery.plans import catalog

ODD = [(7, 3), (7, 4), (7, 3), (30, 3), (30, 5), (61, 0), *((k, k % 4) for k in range(60, 300))]


def shuffled(spark) -> int:
    """Rows that all stages so far have sent."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def customers(spark, path, keys):
    rows = [(k, None if k is None else f"Customer#{k}", n, 0.0, "MACHINERY" if (k or 0) % 2 else "BUILDING") for k, n in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return str(path)


def against_sql(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{path}/customer.parquet/*.parquet'")
    got = catalog.queries()[name](spark, path)
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert want


def few_pairs(spark, tmp_path, name, rows):
    """At most ``rows`` rows a record are shuffled, though some thousand customers of one country share their words."""
    path = customers(spark, tmp_path, [(k, 0) for k in range(1500)])
    records = catalog.norm(spark, path).count()
    before = shuffled(spark)
    assert catalog.queries()[name](spark, path).count()
    assert shuffled(spark) - before < rows * records


def vectors(rng, n, grams, idf, first):
    lists = [np.sort(rng.choice(grams, rng.integers(1, 7), replace=False, p=(p := 1 / np.arange(1, grams + 1)) / p.sum())) for _ in range(n)]
    b = pa.RecordBatch.from_arrays([pa.array([f"{first}{i}" for i in range(n)]), pa.array([[{"gid": int(g), "idf": float(idf[g])} for g in x] for x in lists], pa.list_(pa.struct([("gid", pa.int64()), ("idf", pa.float64())])))], names=["id", "v"])
    return cosine._of_batch(b), lists


@pytest.mark.parametrize(("grams", "common", "sets"), [(6, 64, 1 << 22), (70, 8, 1 << 22), (70, 8, 60), (400, 64, 1 << 22)])
def test_blocks_are_brute_force(monkeypatch, grams, common, sets):
    monkeypatch.setattr(cosine, "COMMON", common)
    monkeypatch.setattr(cosine, "SETS", sets)
    monkeypatch.setattr(cosine, "FLAT", 100)
    rng = np.random.default_rng(grams)
    idf = 1 + rng.integers(0, 3, grams) / 4
    (q, ql), (t, tl) = vectors(rng, 150, grams, idf, "q"), vectors(rng, 900, grams, idf, "t")
    full = np.zeros((2, 900, grams))
    for side, lists in enumerate((ql, tl)):
        for i, x in enumerate(lists):
            full[side, i, x] = idf[x]
    cos = np.round(full[0, :150] @ full[1].T / (np.linalg.norm(full[0, :150], axis=1)[:, None] * np.linalg.norm(full[1], axis=1)), 6)
    want = []
    for i, row in enumerate(cos):
        best = sorted((-c, f"t{j}") for j, c in enumerate(row) if c > 0)[:5]
        want += [(f"q{i}", j, -c, k + 1) for k, (c, j) in enumerate(best)]
    row = lambda v: {**cosine._packed(v), "ids": v.ids}
    bests = cosine._Bests([row(cosine._some(q, np.arange(a, b))) for a, b in ((0, 40), (40, 150))], 5)
    for a, b in ((0, 500), (500, 700), (700, 900)):
        bests.add(2, [row(cosine._some(t, np.arange(a, b)))])
    got = [tuple(x.values()) for b in bests.rows() for x in b.to_pylist()]
    assert got == want


#: Query, and rows that it may shuffle a record.
LINEAR = {"channel_union": 20, "cosine_topk_char": 10, "channels": 80, "cosine_topk_word": 20, "reverse_best_other": 20}


@pytest.mark.parametrize("name", LINEAR)
def test_records_are_shuffled_not_pairs(spark, tmp_path, name):
    few_pairs(spark, tmp_path, name, LINEAR[name])


def test_reverse_features_shuffle_records(spark, tmp_path):
    """Beside the given pairs: the targets' lists are made without pairs that share a word."""
    path = customers(spark, tmp_path, [(k, 0) for k in range(1500)])
    records = catalog.norm(spark, path)
    pairs = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(1, 60, 3)], "s1 string, t string")
    before, n = shuffled(spark), records.count()
    rows = linkage.reverse_features(pairs, records, "name_norm", max_df=0.3).collect()
    assert len(rows) == 20 and all(r.own > 0 for r in rows)
    assert shuffled(spark) - before < 30 * n


@pytest.mark.parametrize("name", [n for n in LINEAR if n in catalog.oracle_sql()])
def test_odd_customers(spark, tmp_path, name):
    """Repeated keys, also of several countries; and a table without queries."""
    against_sql(spark, customers(spark, tmp_path / "odd", ODD), name)
    against_sql(spark, customers(spark, tmp_path / "plain", ODD[6:]), name)
    assert linkage.cosine_top(catalog.norm(spark, str(tmp_path / "plain")).filter("src = 1"), "name_norm", reverse=True).count() == 0


@pytest.mark.parametrize("top", [1, 2, 4])
def test_queries_of_one_set_share_their_candidates(monkeypatch, top):
    """Queries with the same common grams are not each compared with every profile of the targets."""
    rng, made, rounded = np.random.default_rng(top), {}, []
    for side, first, n in (("q", 10_000, 400), ("t", 100, 900)):
        lists = [sorted({int(g) for g in rng.integers(0, 6, 3)}) + [first + i] for i in range(n)]
        grams = [[{"gid": g, "idf": 1 + g / 4 if g < 6 else 1 + g % 997 / 500} for g in x] for x in lists]
        made[side] = cosine._of_batch(pa.RecordBatch.from_arrays([pa.array([f"{side}{i}" for i in range(n)]), pa.array(grams, pa.list_(pa.struct([("gid", pa.int64()), ("idf", pa.float64())])))], names=["id", "v"]))
    q, t, full = made["q"], made["t"], {}
    for side, v in made.items():
        full[side] = np.zeros((len(v), 6))
        own, low = np.repeat(np.arange(len(v)), v.size), v.gid < 6
        full[side][own[low], v.gid[low]] = v.idf[low]
    cos = np.round(full["q"] @ full["t"].T / (q.norm[:, None] * t.norm), 6)
    rank = rng.permutation(len(t))
    want = [(i, j, cos[i, j]) for i in range(len(q)) for j in np.lexsort((rank, -cos[i]))[:top].tolist() if cos[i, j] > 0]
    monkeypatch.setattr(cosine.np, "round", lambda x, *a, f=np.round: (rounded.append(np.size(x)), f(x, *a))[1])
    assert list(zip(*(x.tolist() for x in cosine.best_of(q, t, rank, top)), strict=True)) == want
    assert sum(rounded) < len(q) * len(t) / 8


def test_blocks_of_vectors_are_sent_once_a_group(spark):
    """Not once a shuffle partition; every two vectors still meet once."""
    rows = [(i, [float(i), 1.0, float(i % 7)], 0) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        before = shuffled(spark)
        got = linkage.label_cosines(vectors, 10).collect()
        assert shuffled(spark) - before <= 20 * 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(200) for b in range(a + 1, 200)]
    assert all(r.cos is not None for r in got)


@pytest.mark.parametrize("name", ["cosine_topk_char", "cosine_topk_word", "reverse_best_other"])
def test_repeated_keys_do_not_bring_pairs(spark, tmp_path, name):
    """A few repeated keys, also of several countries, among some thousand records: still records are shuffled, with the rows of the SQL."""
    path = customers(spark, tmp_path, [*((k, 0) for k in range(1500)), (7, 0), (7, 1), (8, 3), (12, 0), (12, 2), (30, 0)])
    records = catalog.norm(spark, path).count()
    before = shuffled(spark)
    against_sql(spark, path, name)
    assert shuffled(spark) - before < 30 * records


@pytest.mark.parametrize("name", ["cosine_topk_char", "cosine_topk_word", "reverse_best_other"])
def test_every_key_repeated(spark, tmp_path, name):
    """Grams that are held several times, in lists and in the sets of common ones; cosines above 1."""
    against_sql(spark, customers(spark, tmp_path, [(k, c) for k in range(150) for c in [0] * (1 + k % 4) + [1] * (k % 7 == 0)]), name)


def test_vectors_travel_in_few_bytes():
    """Under half of 4 bytes a gram and 16 a record and gram number, and the same records come back."""
    v, _ = vectors(np.random.default_rng(5), 3000, 400, 1 + np.arange(400) % 7 / 4, "S2-")
    row = cosine._packed(v)
    assert sum(map(len, (x for x in row.values() if isinstance(x, bytes)))) < (4 * len(v.gid) + 16 * (len(v) + 400)) / 2
    back = cosine._unpacked([row | {"ids": cosine._strings(row["ids"], row["long"])}])
    assert back.ids.equals(v.ids)
    assert all(np.array_equal(getattr(back, c), getattr(v, c)) for c in ("size", "gid", "idf", "times", "norm"))


def test_frequent_grams_leave_before_the_shuffle(spark, tmp_path):
    """Letters of the names are in most records: their grams are not sent to the table of IDF."""
    path = customers(spark, tmp_path, [(k, 0) for k in range(1500)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = catalog.norm(spark, path)
        n, before = records.count(), shuffled(spark)
        assert linkage.gram_vectors(records, "name_norm", True, 0.03).count()
        assert shuffled(spark) - before < 30 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_of_targets_are_read_in_passing(spark, tmp_path, monkeypatch):
    """Nothing is sent for the best other, lists may lie across batches, and addresses are not normalised."""
    rng = np.random.default_rng(3)
    lists = {f"q{i}": sorted(np.round(rng.integers(1, 40, rng.integers(1, 6)) / 40, 6).tolist(), reverse=True) for i in range(60)}
    rows = [(q, f"t{j}", c, j + 1) for q, x in lists.items() for j, c in enumerate(x)]
    scored = spark.createDataFrame(rows, "q string, t string, cos double, rn int").coalesce(1)
    before = shuffled(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = [tuple(r) for r in linkage.best_other(scored).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shuffled(spark) == before
    want = []
    for q, t, c, n in rows:
        x = lists[q]
        other = max([*x[: n - 1], *x[n:]], default=0.0)
        want.append((q, t, c, other, round(c - other, 6), 1 + sum(y > c for y in x), sum(y >= x[0] - 0.05 for y in x) - 1))
    assert got == want
    monkeypatch.setattr(catalog, "norm", None)
    against_sql(spark, customers(spark, tmp_path, [(k, k % 4) for k in range(40)]), "reverse_best_other")


def test_reverse_features_send_a_pair_twice(spark, tmp_path):
    """Not once a gram and entry of a list; pairs with repeated ids (also of several countries), unknown and null ones have the same features."""
    path = customers(spark, tmp_path, [*((k, 0) for k in range(200)), (7, 0), (7, 1), (8, 3), (12, 0), (12, 2), (30, 0)])
    records = catalog.norm(spark, path)
    lists, unit, n = {}, {}, records.count()
    for r in linkage.cosine_top(records, "name_norm", max_df=0.3, top=6, reverse=True).collect():
        lists.setdefault(r.q, []).append((r.t, r.cos))
    for r in linkage.unit_postings(records, "name_norm", False, 0.3).collect():
        unit.setdefault(r.id, []).append((r.country, r.g, r.w))
    known = [(f"S1-{a}", f"S2-{b}") for a in range(1, 200) for b in range(1, 200) if b % 3]
    pairs = [*known, ("S1-7", "S3-12"), ("S1-none", "S2-7"), ("S1-7", "S2-none"), (None, "S2-7"), ("S1-7", None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {(r.s1, r.t): tuple(r)[2:] for r in linkage.reverse_features(spark.createDataFrame(pairs, "s1 string, t string"), records, "name_norm", max_df=0.3).collect()}
        assert shuffled(spark) - before < 3 * len(pairs) + 60 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == set(pairs)
    for (s1, t), (own, other, gap, rnk, n_close) in got.items():
        cos = sum(w * v for c, g, w in unit.get(s1, []) for d, h, v in unit.get(t, []) if (c, g) == (d, h))
        rest = [c for o, c in lists.get(t, []) if s1 is not None and o != s1]
        assert abs(own - cos) < 1e-6 and other == max(rest, default=0.0) and gap == round(own - other, 6)
        assert (rnk, n_close) == (1 + sum(c > own for c in rest), sum(c >= own - 0.05 for c in rest))


def test_channels_keep_all_that_they_are_to_keep(spark, tmp_path):
    """A query's best in every channel are as many as the channel keeps, not a part of them."""
    path = customers(spark, tmp_path, [(k, 0) for k in range(1200)])
    rows, most = catalog.queries()["channels"](spark, path).collect(), {}
    for name in linkage.CHANNELS:
        n = Counter((r.q, r.t.split("-")[0]) for r in rows if r[name] > 0)
        most[name] = max(n.values(), default=0)
    want = {name: spec[4] for name, spec in linkage.CHANNELS.items()} | {"address_fold": 0}  # too few words in all addresses: each is over max_df
    assert most == want
