"""Near-duplicate links and groups by bottom-k sketches from one hash function (operator 6).

1. Every document's distinct word shingles are hashed by one function; the ``k``
   smallest values are its sketch (the whole set, if that is smaller).  Documents with
   equal sets are one class, told apart by two sums over the set; only classes go on.
2. *Inverted lists* of retained values.  Two sets with similarity 0.8 share at
   least ``k / 2`` of ``k`` retained values (all but about 4 in 10**9 such pairs, for k = 64), so they
   share c of the ``k / 2 + c`` rarest by any common order; only those are listed, the rarest
   first.  With c = ``GROUPS + 1`` two of these fall into one of ``GROUPS`` groups by hash, so a list is kept for each
   two values of a group that a set lists: texts that have one rare run of words in common do not meet.
   Values are counted exactly, but for hot ones, which a table of fixed size finds: they come
   last, and are not gathered.  For sets smaller than the
   sketch the same bound follows from the similarity itself, and holds for every pair; where it is
   under c (sets of a few shingles) single values are listed as well.
3. *Cells.*  All lists with the same least member are one cell: copies of a text share most of their lists, and so
   meet once and not once a list.  A cell with more than ``CELL_SETS`` sets or ``CELL_SHINGLES`` shingles is dealt
   into blocks, and each two blocks are a cell of their own.  Two members of a list are in a cell together: no list is cut.
4. *Union-sketch estimate* of the pairs of a cell: the share of the ``k`` smallest values of both sketches' union
   that both have.  Pairs under 0.8 less five standard errors go; with both sets whole the estimate is exact.
5. *Exact verification* on the full sets, from the documents' texts, of members that have a partner left.
   A cell counts the overlaps of all its sets at once.  It gives a spanning forest of its links,
   at most a row a member; the links' connected components are the groups.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer
words than a shingle are one shingle; rows sharing a doc_id are one document (its
links are those of any of its texts); a null doc_id is linked with nothing and kept; an empty table gives no rows;
a text may be of any length; other columns are ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from . import words as w

K, GROUPS, SLOT_BITS, ID_BITS = 64, 4, 16, 22
CELL_SETS, CELL_SHINGLES, OFTEN, PAIRS = 512, 1 << 20, 24, 1 << 14
#: Rows of an Arrow batch, of texts or sets.
BATCH = 1000
#: A slot of values is hot if it holds this many times the mean, and this many values at least.
HOT_TIMES, HOT_LEAST = 64, 20_000
_VALUE = np.dtype([("value", "<u8"), ("key", "<i8")])
#: Of a class: a value that others hold as well, with the number of holders; or, with no holders, the set's size.
_SHARED = np.dtype([("key", "<i8"), ("value", "<u8"), ("holders", "<i8")])
_HOT = 1 << 40


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of the column: first row, sorted distinct (row, hash) as two arrays."""
    for at, _, data, offs in w.parts(column):
        text = w.words(data, offs, w.SPACED, True)
        begin, h = text.runs(size)
        rows = text.of()[begin] if len(begin) else np.empty(0, np.int64)
        count = np.diff(text.first)
        for i in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence
            _, own = w.run_hashes(text.hashes[text.first[i] : text.first[i + 1]], np.array([0, count[i]]), int(count[i]))
            rows, h = np.append(rows, i), np.append(h, own)
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        yield at, rows[new], h[new]


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n (set size), two sums that name the set, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_rows = b.num_rows
            n, one, two, sketch = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64), [b""] * n_rows
            for at, rows, h in shingle_sets(b.column("text"), size):
                if not len(rows):
                    continue
                cut, first, second = _sums(rows, h)
                own, count = at + rows[cut], np.diff(np.r_[cut, len(rows)])
                n[own], one[own], two[own] = count, first, second
                for r, c, m in zip(own.tolist(), cut.tolist(), count.tolist(), strict=True):
                    sketch[r] = h[c : c + min(m, k)].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketch, pa.binary())], names=["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, n long, s1 long, s2 long, sketch binary")


def _value_counts(classes: DataFrame) -> np.ndarray:
    """How often retained values fall into each slot of a table of fixed size (256 KB)."""
    blocks, slots = 32, 1 << SLOT_BITS
    per = slots // blocks

    def rows(which, tables) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in tables], pa.binary())], names=["_bucket", "_blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, np.int64)
        for b in batches:
            v = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u8")
            table += np.bincount(_slot(v), minlength=slots)
        if table.any():
            yield rows(range(blocks), table.reshape(blocks, per))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column("_bucket").to_pylist(), b.column("_blob").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(blob, "<i4").astype(np.int64)
        if sums:
            yield rows(sums.keys(), sums.values())

    table = np.zeros(slots, np.int32)
    for row in classes.select("sketch").mapInArrow(common.tidy(count), common.PACKED).repartition(blocks, "_bucket").mapInArrow(common.tidy(add), common.PACKED).collect():
        table[row[0] * per : (row[0] + 1) * per] = np.frombuffer(row[1], "<i4")
    return table


def _slot(values: np.ndarray) -> np.ndarray:
    return (w.mix(values) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _listed(n: np.ndarray, k: int, percent: int, common_values: int) -> np.ndarray:
    """How many values, rarest first, hold so many that two similar sets have in common."""
    m = np.minimum(n, k)
    return np.clip(m - _sure(n, k, percent) + common_values, 0, m)


def _sure(n: np.ndarray, k: int, percent: int) -> np.ndarray:
    """How many retained values two similar sets have in common at least."""
    return np.where(n * 100 <= percent * k, -(-percent * n // 100), k // 2)


def _value_pairs(key: np.ndarray, value: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each two listed values of one group of a class: a name of both, the class, and whether both are hot."""
    group = (w.mix(value ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(GROUPS)).astype(np.int64)
    order = np.lexsort((value, group, key))
    key, value, hot, group = key[order], value[order], hot[order], group[order]
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(cut, len(key)))
    names, keys, hots = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for m in np.unique(size[size > 1]).tolist():
        at = cut[size == m]
        i, j = np.triu_indices(m, 1)
        x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        names.append(w.mix(w.mix(value[x]) + np.uint64(3) * value[y]))
        keys.append(key[x])
        hots.append(hot[x] & hot[y])
    return np.concatenate(names), np.concatenate(keys), np.concatenate(hots)


def _lists(classes: DataFrame, counts: np.ndarray, k: int, percent: int, parts: int) -> DataFrame:
    """leader and key: the cells that each class is in, by lists' least members (a list of hot values names itself)."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    hot_from = max(HOT_LEAST, HOT_TIMES * counts.mean())
    least = next(n for n in range(1, 10 * GROUPS + 10) if -(-percent * n // 100) > GROUPS) - 1  # sets up to this size may share fewer values than are asked for

    def bucket(values: np.ndarray) -> np.ndarray:
        return (w.mix(values.view(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def packed(buckets: np.ndarray, records: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        for b in common.pack(buckets, parts, records):
            yield b.append_column("own", pa.array(np.full(b.num_rows, own)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                keys, n = b.column("s1").to_numpy(), b.column("n").to_numpy()
                held = [np.frombuffer(x, "<u8") for x in b.column("sketch").to_pylist()]
                v, row = np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held)))
                often = table[_slot(v)]
                hot = often >= hot_from
                r = np.empty(int((~hot).sum()), _VALUE)
                r["value"], r["key"] = v[~hot], keys[row[~hot]]
                yield from packed(bucket(r["value"]), r, False)
                own = np.zeros(int(hot.sum()) + len(keys), _SHARED)
                own["key"], own["value"] = np.r_[keys[row[hot]], keys], np.r_[v[hot], n.astype(np.uint64)]
                own["holders"][: hot.sum()] = often[hot].astype(np.int64) + _HOT
                yield from packed(bucket(own["key"]), own, True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for to, blob, own in zip(*(b.column(c).to_pylist() for c in ("_bucket", "_blob", "own")), strict=True):
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([blob], pa.binary())], names=["_bucket", "_blob"])
                else:
                    held.append(np.frombuffer(blob, _VALUE))
        if not held:
            return
        r = np.concatenate(held)
        r = r[np.argsort(r["value"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, r["value"][1:] != r["value"][:-1]])
        size = np.diff(np.append(cut, len(r)))
        own = np.repeat(size > 1, size)
        out = np.empty(int(own.sum()), _SHARED)
        out["key"], out["value"], out["holders"] = r["key"][own], r["value"][own], np.repeat(size, size)[own]
        yield from common.pack(bucket(out["key"]), parts, out)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = common.unpack(batches, _SHARED)
        r = r[np.lexsort((r["value"], r["holders"], r["key"]))]
        if not len(r):
            return
        cut = np.flatnonzero(np.r_[True, r["key"][1:] != r["key"][:-1]])
        size = np.diff(np.append(cut, len(r)))
        n = r["value"][cut].astype(np.int64)  # a class's own record is its first
        alone = np.minimum(n, k) - (size - 1)  # values that nobody else holds come before all
        place = np.arange(len(r)) - np.repeat(cut, size) - 1 + np.repeat(alone, size)
        other = r["holders"] > 0
        own = other & (place < np.repeat(_listed(n, k, percent, GROUPS + 1), size))
        names, keys, hot = _value_pairs(r["key"][own], r["value"][own], r["holders"][own] >= _HOT)
        single = other & (place < np.repeat(_listed(n, k, percent, 1), size)) & np.repeat(n * percent <= 100 * least, size)
        out = np.empty(len(names) + int(single.sum()), _VALUE)
        out["value"], out["key"] = np.r_[names, w.mix(r["value"][single])], np.r_[keys, r["key"][single]]
        hot = np.r_[hot, r["holders"][single] >= _HOT]
        yield from packed(bucket(out["value"][~hot]), out[~hot], False)
        yield from packed(bucket(out["value"][hot]), out[hot], True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for blob, own in zip(b.column("_blob").to_pylist(), b.column("own").to_pylist(), strict=True):
                r = np.frombuffer(blob, _VALUE)
                if own:  # of hot values: unbounded, and already named
                    yield from common.pack(bucket(r["key"]), parts, r)
                else:
                    held.append(r)
        if not held:
            return
        r = np.concatenate(held)
        r = r[np.lexsort((r["key"], r["value"]))]
        cut = np.flatnonzero(np.r_[True, r["value"][1:] != r["value"][:-1]])
        size = np.diff(np.append(cut, len(r)))
        own = np.repeat(size > 1, size)
        out = np.empty(int(own.sum()), _VALUE)
        out["value"], out["key"] = np.repeat(r["key"][cut], size)[own].view(np.uint64), r["key"][own]
        out = np.unique(out)  # a document shares many lists with the same others
        yield from common.pack(bucket(out["key"]), parts, out)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.unique(common.unpack(batches, _VALUE))
        for at in range(0, len(r), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(r["value"][at : at + 100_000].view(np.int64)), pa.array(r["key"][at : at + 100_000])], names=["leader", "key"])

    to = f"{common.PACKED}, own boolean"
    counted = classes.select("n", "s1", "sketch").mapInArrow(common.tidy(post), to).repartition(parts, "_bucket").mapInArrow(common.tidy(count), common.PACKED)
    chosen = counted.repartition(parts, "_bucket").mapInArrow(common.tidy(choose), to)
    met = chosen.repartition(parts, "_bucket").mapInArrow(common.tidy(meet), common.PACKED)
    return met.repartition(parts, "_bucket").mapInArrow(common.tidy(unique), "leader long, key long")


def _members(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """leader, cell, block, key: who meets in which cell; a list that only one class is in makes none."""
    own = classes.select(F.col("s1").alias("key"), "n")
    sizes = lists.join(own, "key").groupBy("leader").agg(F.count("*").alias("c"), F.sum("n").alias("all")).filter("c > 1")
    blocks = F.ceil(F.greatest(F.col("c") / CELL_SETS, F.col("all") / CELL_SHINGLES)).cast("int")
    dealt = lists.join(sizes.select("leader", blocks.alias("blocks")), "leader").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = lambda y: F.least("block", y) * F.col("blocks") + F.greatest("block", y)
    return dealt.select("leader", "block", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)).alias("cell"))


def _in_cells(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "leader", "cell").sortWithinPartitions("leader", "cell", "rep", "key")


def whole_cells(batches: Iterator[pa.RecordBatch], blob: str, most: int = 2 << 20) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole cells, of about ``most`` bytes and pairs, or one cell."""
    held: list[pa.RecordBatch] = []

    def cut(done: bool) -> Iterator[pa.Table]:
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        ends = np.append(_starts(t)[1:], t.num_rows)
        cost = np.cumsum([len(x) for x in t.column(blob).to_pylist()])[ends - 1] + np.cumsum(np.diff(np.append(0, ends)) ** 2)
        at = begin = 0
        full = len(ends) if done else len(ends) - 1  # the last cell may go on
        while at < full:
            spent = cost[at - 1] if at else 0
            to = min(full, max(at + 1, int(np.searchsorted(cost, spent + most, side="right"))))
            yield t.slice(begin, ends[to - 1] - begin)
            begin, at = int(ends[to - 1]), to
        held = t.slice(begin).to_batches() if begin < t.num_rows else []

    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size > 16 << 20:
                yield from cut(False)
                size = 0
    if held:
        yield from cut(True)


def _starts(t: pa.Table) -> np.ndarray:
    leader, cell = (t.column(c).to_numpy() for c in ("leader", "cell"))
    return np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (cell[1:] != cell[:-1])])


class Cells:
    """Rows of whole cells: each row's cell, its place there, and the pairs that a cell is for."""

    def __init__(self, t: pa.Table, n: np.ndarray) -> None:
        self.start = _starts(t)
        self.size = np.diff(np.append(self.start, t.num_rows))
        self.cell = np.repeat(np.arange(len(self.start)), self.size)
        self.place = np.arange(t.num_rows) - self.start[self.cell]
        self.rep, self.key, self.block, self.n = t.column("rep").to_numpy(), t.column("key").to_numpy(), t.column("block").to_numpy(), n
        low = np.minimum.reduceat(self.block, self.start)
        self.mixed = (low < np.maximum.reduceat(self.block, self.start))[self.cell]  # a cell of two blocks

    def fit(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether these pairs of rows are to be compared: by sizes, different documents, and not within a block that has a cell of its own."""
        n, m = self.n[a], self.n[b]
        return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (self.rep[a] != self.rep[b]) & ((self.block[a] != self.block[b]) | ~self.mixed[a])

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, total = [], 0
        for start, m in zip(self.start.tolist(), self.size.tolist(), strict=True):
            for i in range(start, start + m - 1):
                held.append((i, start + m))
                total += start + m - 1 - i
                if total >= PAIRS:
                    yield self._rows(held, percent)
                    held, total = [], 0
        if held:
            yield self._rows(held, percent)

    def _rows(self, held: list[tuple[int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
        first, end = np.array(held, np.int64).T
        count = end - first - 1
        a = np.repeat(first, count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
        ok = self.fit(a, b, percent)
        return a[ok], b[ok]

    def overlaps(self, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows (a before b) that share values, and how many: rare values pair by pair, frequent ones by matrix products."""
        order = np.lexsort((value, self.cell[row]))
        row, value = row[order], value[order]
        cell = self.cell[row]
        base = np.cumsum(self.size**2) - self.size**2
        total = np.zeros(int((self.size**2).sum()), np.int32)
        cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])]) if len(row) else np.empty(0, np.int64)
        often = np.diff(np.append(cut, len(row)))
        for f in range(2, OFTEN + 1):
            own, step = cut[often == f], max(1, (1 << 21) // (f * f))
            x, y = np.triu_indices(f, 1)
            for at in range(0, len(own), step):
                who = row[own[at : at + step, None] + np.arange(f)]
                c = self.cell[who[:, 0]]
                here = (base[c][:, None] + self.place[who[:, x]] * self.size[c][:, None] + self.place[who[:, y]]).ravel()
                np.add.at(total, here, 1) if len(here) < len(total) else np.add(total, np.bincount(here, minlength=len(total)), out=total, casting="unsafe")
        many = np.flatnonzero(often > OFTEN)
        of = cell[cut[many]]
        for c in np.unique(of).tolist():
            own, m = many[of == c], int(self.size[c])
            both = np.zeros((m, m), np.float32)
            for at in range(0, len(own), 2048):
                has = np.zeros((m, len(own[at : at + 2048])), np.float32)
                for i, v in enumerate(own[at : at + 2048].tolist()):
                    has[self.place[row[cut[v] : cut[v] + often[v]]], i] = 1
                both += has @ has.T
            total[base[c] : base[c] + m * m] += np.triu(both, 1).ravel().astype(np.int32)
        found = np.flatnonzero(total)
        c = np.searchsorted(base, found, side="right") - 1
        inner = found - base[c]
        return self.start[c] + inner // self.size[c], self.start[c] + inner % self.size[c], total[found].astype(np.int64)

    def forest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links between documents such that the pairs' components stay as they are: each row and the first of its component."""
        label = np.arange(len(self.rep))
        while True:
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            np.minimum.at(label, before, label.copy())
            label = label[label]
            if (label == before).all():
                break
        own = np.flatnonzero(label != np.arange(len(label)))
        return self.rep[own], self.rep[label[own]]


def _estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches (rows, filled up with the greatest value): may be similar; and is, with both sets whole."""
    fill = np.uint64(2**64 - 1)
    joined = np.sort(np.concatenate([x, y], 1), 1)
    twice = (joined[:, 1:] == joined[:, :-1]) & (joined[:, 1:] != fill)
    values = (joined != fill).sum(1) - twice.sum(1)
    rank = np.arange(twice.shape[1])[None] - (np.cumsum(twice, 1) - twice)  # of a value that both have, in the union
    top = np.minimum(k, values)
    whole = (n <= k) & (m <= k)
    exact = 100 * twice.sum(1) >= percent * values
    slack = 5 * (0.16 / k) ** 0.5
    likely = (twice & (rank < top[:, None])).sum(1) >= (percent / 100 - slack) * top
    return np.where(whole, exact, likely), whole & exact


def _estimated(members: DataFrame, classes: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Links among whole sets (a, b; leader null), and members with a partner that the estimate leaves open (leader, cell, block, rep, key)."""
    schema = "leader long, cell int, block int, rep long, key long, a long, b long"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, "sketch"):
            n = t.column("n").to_numpy()
            cells, sketch = Cells(t, n), np.full((t.num_rows, k), np.uint64(2**64 - 1))
            for i, x in enumerate(t.column("sketch").to_pylist()):
                sketch[i, : len(x) // 8] = np.frombuffer(x, "<u8")
            still, la, lb = np.zeros(t.num_rows, bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in cells.pairs(percent):
                ok, sure = _estimate(sketch[a], sketch[b], n[a], n[b], k, percent)
                la.append(a[sure])
                lb.append(b[sure])
                still[a[ok & ~sure]] = still[b[ok & ~sure]] = True
            x, y = cells.forest(np.concatenate(la), np.concatenate(lb))
            own = t.filter(pa.array(still)).select(["leader", "cell", "block", "rep", "key"])
            none = lambda c, m: pa.nulls(m, c.type)
            names = ["leader", "cell", "block", "rep", "key", "a", "b"]
            if own.num_rows:
                yield from own.append_column("a", pa.nulls(own.num_rows, pa.int64())).append_column("b", pa.nulls(own.num_rows, pa.int64())).to_batches()
            if len(x):
                yield pa.RecordBatch.from_arrays([*[none(t.column(c), len(x)) for c in names[:5]], pa.array(x), pa.array(y)], names=names)

    own = members.join(classes.select("rep", F.col("s1").alias("key"), "n", "sketch"), "key")
    return _in_cells(own.select("leader", "cell", "block", "rep", "key", "n", "sketch"), parts).mapInArrow(common.tidy(judge), schema)


def _screened(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose id may be a ``rep`` of ``wanted``: by a bit table of fixed size (512 KB), so that few other texts are shuffled."""
    slots, pieces = 1 << ID_BITS, 16
    slot = lambda ids: (w.mix(ids.astype(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, bool)
        for b in batches:
            table[slot(b.column("rep").to_numpy(zero_copy_only=False))] = True
        if table.any():
            packed = np.packbits(table).reshape(pieces, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["_bucket", "_blob"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column("_bucket").to_pylist(), b.column("_blob").to_pylist(), strict=True):
                got[i] = got.get(i, 0) | np.frombuffer(blob, np.uint8)
        for i, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["_bucket", "_blob"])

    table = np.zeros((pieces, slots // 8 // pieces), np.uint8)
    for row in wanted.select("rep").mapInArrow(common.tidy(bits), common.PACKED).repartition(pieces, "_bucket").mapInArrow(common.tidy(either), common.PACKED).collect():
        table[row[0]] = np.frombuffer(row[1], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(known & own[slot(ids.fill_null(0).to_numpy(zero_copy_only=False))]))

    return docs.select("doc_id", "text").mapInArrow(common.tidy(keep), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def _sums(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (row, hash) pairs: each set's first place, and the two sums that name it."""
    cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return cut, np.add.reduceat(w.mix(h), cut), np.add.reduceat(w.mix(h ^ np.uint64(0x5851F42D4C957F2D)), cut)


def _verified(open_members: DataFrame, docs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Links a, b among members of a cell, by the full sets of their texts."""
    lists = open_members.groupBy("rep").agg(F.collect_list(F.struct("key", "leader", "cell", "block")).alias("cells"))  # a document's lists are few
    texts = _screened(docs, open_members).select(F.col("doc_id").cast("long").alias("rep"), "text")
    kinds = "leader long, cell int, block int, rep long, key long, shingles binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, cells = b.column("rep").to_pylist(), b.column("cells").to_pylist()
            for at, rows, h in shingle_sets(b.column("text"), size):
                if not len(rows):
                    continue
                cut, names, _ = _sums(rows, h)
                out = []
                for c, d, i, key in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], (at + rows[cut]).tolist(), names.view(np.int64).tolist(), strict=True):
                    blob = h[c:d].tobytes()
                    out += [(x["leader"], x["cell"], x["block"], reps[i], key, blob) for x in cells[i] if x["key"] == key]
                if out:
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["leader", "cell", "block", "rep", "key", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, "shingles", 8 << 20):
            held = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
            n = np.array([len(x) for x in held])
            cells = Cells(t, n)
            a, b, both = cells.overlaps(np.repeat(np.arange(len(n)), n), np.concatenate(held))
            ok = (100 * both >= percent * (n[a] + n[b] - both)) & cells.fit(a, b, percent)
            x, y = cells.forest(a[ok], b[ok])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    sets = texts.join(lists, "rep").mapInArrow(common.tidy(send), kinds)
    return _in_cells(sets, parts).mapInArrow(common.tidy(judge), "a long, b long")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    parts = common.parts_for(docs.select("doc_id", "text"))
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    own = common.materialise(sketches(docs, shingle, k), "sketches", BATCH)
    sets = own.filter("n > 0 and doc_id is not null")
    classes = sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
    classes = common.materialise(classes, "classes")
    lists = common.materialise(_lists(classes, _value_counts(classes), k, percent, parts), "lists", BATCH)
    common.drop_shuffles(spark)
    judged = common.materialise(_estimated(_members(classes, lists), classes, k, percent, parts), "judged", BATCH)
    common.drop(lists)
    common.drop_shuffles(spark)
    verified = common.materialise(_verified(judged.filter("leader is not null"), docs, shingle, percent, parts), "verified", BATCH)
    # rows that share a doc_id are one document
    shared = sets.select("doc_id", "n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
    same = shared.filter("rep <> doc_id").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    label = components.components(same.unionByName(judged.filter("leader is null").select("a", "b")).unionByName(verified))
    common.drop(judged, verified)
    common.drop_shuffles(spark)
    final = classes.join(label, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("_component"))
    # a doc_id with several texts gets the least of their components, which are one
    out = own.select("doc_id", "n", "s1", "s2").join(final, ["n", "s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
