"""Approximate nearest neighbours by additive quantisation (operator 4).

A vector is encoded as the sum of one codeword from each of ``BOOKS`` codebooks
of full dimension, found by beam search over residuals; the norm of the sum is stored.
A query's table of products with all codewords then gives each candidate's
distance from lookups and the stored norm.

Candidates lie in cells by their codeword of the first codebook, and a query visits the ``PROBES`` cells whose codewords
are nearest to it.  A first pass finds, by lookups alone, how far the ``SHORTLIST``-th best of all its candidates is;
a second pass measures on the original vectors those that are no farther, and no others: one shortlist a query.

Cells meet queries through an equi-join on cell and bucket (a hot cell's blocks lie in many buckets), block by
block, so memory is bounded by two blocks and the running bests; nothing that grows is broadcast.

The codebooks are fitted on at most ``MAX_TRAIN`` vectors, those of the smallest hash of
vec_id; every vector is encoded.

Defined results: vectors that are null, zero, hold null or non-finite components, have a null
vec_id or another dimension than most of the sample take no part; ties go to the smaller
vec_id; rows with the query's own vec_id are not its candidates; repeated rows are one
candidate each; a query id with several valid vectors asks with the least of them (compared component by component);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BOOKS, WORDS, BEAM, MAX_TRAIN, BLOCK, QUERIES, PROBES, SHORTLIST, NEAREST, EVERY = 20, 64, 4, 8192, 4096, 256, 56, 2048, 10, 100
#: Vectors that a task holds before it writes blocks, candidates looked up at a time, and blocks of queries whose tables are kept.
HELD, STRIP, KEPT = 65536, 512, 12


def valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(ok)


def _assign(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1)[None] - 2 * x @ book.T, 1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 10) -> np.ndarray:
    """Codebooks: k-means of what the former ones leave, then least squares for all at once over beam-search codes."""
    rng, left, out = np.random.default_rng(7), x.astype(np.float64), []
    k = min(words, len(x))
    for _ in range(books):
        book = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            own = _assign(left, book)
            n = np.bincount(own, minlength=k)
            sums = np.zeros_like(book)
            np.add.at(sums, own, left)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        left = left - book[_assign(left, book)]
        out.append(book)
    codebooks = np.stack(out)
    for _ in range(2):
        codes = encode(x, codebooks)[0]
        hot = np.zeros((len(x), books * k), np.float32)
        for m in range(books):
            hot[np.arange(len(x)), m * k + codes[:, m].astype(np.int64)] = 1
        gram = hot.T @ hot + np.eye(books * k) * 1e-2
        codebooks = (codebooks.reshape(books * k, -1) + np.linalg.solve(gram, hot.T @ (x - _sum(codes, codebooks)))).reshape(codebooks.shape)
    return codebooks


def _sum(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and squared norms of the sums of their codewords; ``STRIP`` vectors at a time."""
    parts = [_encode(x[at : at + STRIP], books, beam) for at in range(0, max(len(x), 1), STRIP)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(x), books.shape[1]
    codes, left = np.zeros((n, 1, 0), np.int64), x.astype(np.float64)[:, None, :]
    for book in books:
        width = left.shape[1]
        error = (left**2).sum(2)[:, :, None] + (book**2).sum(1)[None, None] - (2 * left.reshape(n * width, -1) @ book.T).reshape(n, width, k)
        flat = error.reshape(n, width * k)
        most = min(beam, width * k)
        rows = np.arange(n)[:, None]
        best = np.empty((n, most), np.int64)
        for j in range(most):
            best[:, j] = flat.argmin(1)
            flat[rows[:, 0], best[:, j]] = np.inf
        parent, word = best // k, best % k
        left = left[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None]], 2)
    best = np.argmin((left**2).sum(2), 1)
    codes = codes[np.arange(n), best]
    return codes.astype(np.uint8 if k <= 256 else np.int64), (_sum(codes, books) ** 2).sum(1)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right dimension, as 64-bit floats."""
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ok, flat.reshape(len(ok), dim)


def _blocks(vectors: DataFrame, books: np.ndarray, dim: int, buckets: int) -> DataFrame:
    """Candidates by cell: cell, bucket, ids, vectors (as precise as they came), codes, norms.  A task holds at most ``HELD`` until a cell has ``BLOCK``."""
    narrow = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def block(cell: int) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held.pop(cell), strict=True)]
            for at in range(0, size.pop(cell), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *[pa.array([c[at : at + BLOCK].tobytes()], pa.binary()) for c in columns]], names=["cell", "ids", "vectors", "codes", "norms"])

        for b in batches:
            ok, x = _matrix(b.column("embedding"), dim)
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)[ok].astype("<i8")
            if not len(ids):
                continue
            codes, norms = encode(x, books)
            x = x.astype("<f4" if narrow else "<f8")
            for cell in np.unique(codes[:, 0]).tolist():
                own = np.flatnonzero(codes[:, 0] == cell)
                held.setdefault(cell, []).append((ids[own], x[own], codes[own], norms[own].astype("<f8")))
                size[cell] = size.get(cell, 0) + len(own)
                if size[cell] >= BLOCK:
                    yield from block(cell)
            while sum(size.values()) > HELD:
                yield from block(max(size, key=size.get))
        for cell in list(held):
            yield from block(cell)

    own = vectors.mapInArrow(common.tidy(run), "cell int, ids binary, vectors binary, codes binary, norms binary")
    return own.withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int"))


def _asked(queries: DataFrame, books: np.ndarray, dim: int, probes: int, buckets: int) -> DataFrame:
    """Queries (vec_id, embedding, far) by the cells that they visit: cell, bucket, q_ids, q, far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _matrix(b.column("embedding"), dim)
            if not len(ok):
                continue
            ids, far = (b.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("vec_id", "far"))
            near = (books[0] ** 2).sum(1)[None] - 2 * x @ books[0].T
            n = min(probes, len(books[0]))
            cells = np.argpartition(near, n - 1, 1)[:, :n]
            for cell in np.unique(cells).tolist():
                whole = np.flatnonzero((cells == cell).any(1))
                for own in (whole[at : at + QUERIES] for at in range(0, len(whole), QUERIES)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (ids[own].astype("<i8"), x[own].astype("<f8"), far[own].astype("<f8"))]],
                        names=["cell", "q_ids", "q", "far"],
                    )

    own = queries.select("vec_id", "embedding", "far").mapInArrow(common.tidy(run), "cell int, q_ids binary, q binary, far binary")
    return own.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


def tables_of(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Twice the products of every codeword with every query: book, word, query."""
    return np.ascontiguousarray((2 * (books.reshape(-1, books.shape[2]) @ q.T)).reshape(*books.shape[:2], len(q)))


def lookups(q_ids: np.ndarray, tables: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances to the coded candidates, less the query's own square, by tables; a query's own rows are infinitely far.  A row a candidate, a column a query.

    A candidate's entries of a table lie side by side for all queries; ``STRIP`` candidates at a time stay in the processor's cache.
    """
    rough = np.empty((len(ids), len(q_ids)))
    spare = np.empty((min(STRIP, len(ids)), len(q_ids)))
    for at in range(0, len(ids), STRIP):
        own, some = rough[at : at + STRIP], codes[at : at + STRIP]
        own[:] = norms[at : at + STRIP, None]
        for m in range(len(tables)):
            own -= np.take(tables[m], some[:, m], axis=0, out=spare[: len(own)], mode="clip")
    same = np.flatnonzero(np.isin(ids, q_ids))
    rough[same] = np.where(ids[same, None] == q_ids[None], np.inf, rough[same])
    return rough


class Bests:
    """The ``most`` least values seen for each query.  Values wait until half as many more are there; those that cannot be among the least are not kept."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.size, self.worst = most, {}, {}, {}

    def add(self, query: int, values: np.ndarray) -> None:
        worst = self.worst.get(query)
        values = values if worst is None else values[values < worst]
        self.held.setdefault(query, []).append(values)
        self.size[query] = self.size.get(query, 0) + len(values)
        if self.size[query] >= self.most + self.most // 2:
            self.cut(query)

    def cut(self, query: int) -> np.ndarray:
        both = np.concatenate(self.held[query])
        if len(both) >= self.most:
            both = np.partition(both, self.most - 1)[: self.most]
            self.worst[query] = both[self.most - 1]
        self.held[query], self.size[query] = [both], len(both)
        return both

    def rows(self) -> Iterator[pa.RecordBatch]:
        own = list(self.held)
        for at in range(0, len(own), 5000):
            some = own[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([self.cut(k).astype("<f4").tobytes() for k in some], pa.binary())], names=["vec_id", "values"])
        self.held, self.size, self.worst = {}, {}, {}


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, shortlist: int = SHORTLIST, probes: int = PROBES, max_train: int = MAX_TRAIN) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's nearest candidates."""
    vectors, queries = valid(vectors), valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train).collect()
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out)
    sizes = [len(r.embedding) for r in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    books = fit(np.array([r.embedding for r in sample if len(r.embedding) == dim], np.float64))
    parts = common.shuffle_parts(spark)
    buckets = -(-parts // len(books[0]))
    found = common.materialise(_blocks(vectors, books, dim, buckets), "blocks")
    queries = queries.coalesce(max(1, parts // 8))  # so that a task's queries fill blocks
    read = lambda r, name, kind, *shape: np.frombuffer(r[name], kind).reshape(*shape)

    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tables: dict[bytes, np.ndarray] = {}  # of the last queries: a cell's come again with each of its blocks
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                q_ids, q, ids = read(r, "q_ids", "<i8", -1), read(r, "q", "<f8", -1, dim), read(r, "ids", "<i8", -1)
                own = tables.pop(r["q_ids"], None)
                tables[r["q_ids"]] = own = tables_of(q, books) if own is None else own
                if len(tables) > KEPT:
                    del tables[next(iter(tables))]
                yield r, q_ids, q, ids, lookups(q_ids, own, ids, read(r, "codes", np.uint8, -1, len(books)), read(r, "norms", "<f8", -1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Bests(shortlist)
        for _, q_ids, _, _, rough in cells(batches):
            for own, values in zip(q_ids.tolist(), np.ascontiguousarray(rough.T), strict=True):
                best.add(own, values)
            if len(best.held) * shortlist > 4 << 20:
                yield from best.rows()
        yield from best.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Bests(shortlist)
        for b in batches:
            for k, v in zip(b.column("vec_id").to_pylist(), b.column("values").to_pylist(), strict=True):
                best.add(k, np.frombuffer(v, "<f4"))
        for b in best.rows():
            far = [float(np.frombuffer(v, "<f4").max()) for v in b.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(far, pa.float64())], names=["vec_id", "far"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, q_ids, q, ids, rough in cells(batches):
            far, x = read(r, "far", "<f8", -1), read(r, "vectors", kind, -1, dim)
            who, take = np.nonzero(np.ascontiguousarray(((rough <= far + 1e-6 * (1 + np.abs(far))) & (rough < np.inf)).T))
            exact = np.concatenate([np.zeros(0), *[np.sqrt(((x[take[at : at + STRIP]].astype(np.float64) - q[who[at : at + STRIP]]) ** 2).sum(1)) for at in range(0, len(take), STRIP)]])
            order = np.lexsort((ids[take], exact, who))
            order = order[np.arange(len(order)) - np.searchsorted(who, who) < nearest]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who[order]]), pa.array(ids[take[order]]), pa.array(exact[order])], names=["query_id", "vec_id", "score"])

    ask = lambda own, asked: own.hint("merge").join(_asked(asked, books, dim, probes, buckets), ["cell", "bucket"])
    held = ask(found.drop("vectors"), queries.withColumn("far", F.lit(0.0))).mapInArrow(common.tidy(first), "vec_id long, values binary")
    far = common.materialise(held.repartition(parts, "vec_id").mapInArrow(common.tidy(merge), "vec_id long, far double"), "shortlists")
    near = ask(found, queries.join(far.hint("merge"), "vec_id")).mapInArrow(common.tidy(second), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def every_hundredth(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0))
