"""Blocks and shortlists of operator 4."""

import numpy as np

from joinery.llm import ann


def test_blocks_fill_across_batches_and_shortlists_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4)).astype("f4").astype(float)
    books = ann.fit(x[:500], 3, 8)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        blocks = ann._blocks(frame, books, 4, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(blocks) == len({r.cell for r in blocks})
    got = {int(i): v.tolist() for r in blocks for i, v in zip(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<f4").reshape(-1, 4), strict=True)}
    assert got == {i: v.tolist() for i, v in enumerate(x)}
    codes, norms = ann.encode(x, books)
    ids = np.arange(len(x))
    rough = ann.lookups(ids[:9], ann.tables_of(x[:9], books), ids, codes, norms)
    want = norms[:, None] - 2 * ann._sum(codes, books) @ x[:9].T
    want[ids[:9], ids[:9]] = np.inf
    assert np.allclose(rough, want)
    best = ann.Bests(100)
    for at in range(0, 2000, 37):
        best.add(0, rough[at : at + 37, 0])
    kept = np.frombuffer(next(best.rows()).column("values")[0].as_py(), "<f4")
    assert sorted(kept) == sorted(np.sort(rough[:, 0])[:100].astype("f4"))
