"""Substring deduplication by prefix-partitioned suffix trees (operator 9).

A suffix is the words of a document from some place on.  Only nodes at least
``window`` words deep matter, so suffixes count by their first ``window`` words.

1. *Screen.*  Of all ``window - gram + 1`` grams inside a window the one with the smallest
   hash is its anchor, so equal windows have equal anchors.  Grams at anchors
   (about a sixth of all places) are grouped by hash; the windows of an anchor that occurs
   once are leaves that hang above the depth that matters, and are left out.  Nothing is lost.
2. *Partitioning.*  What remains goes, with its words, where its anchor says: neighbouring
   suffixes mostly share an anchor, so they travel as one run of words.  Where anchors are hot
   (a table of fixed size counts them) each suffix goes where the whole window says instead.
   In a partition suffixes are split by prefixes of as many words as it takes until a group has no
   more than ``group_size`` suffixes (or the prefix is the whole window).
3. *Subtrees.*  Each group's tree is built from the root down: a node's suffixes are sorted by
   their next words, and each run of equal words is a child; a child with one suffix is
   a leaf.  What is left at depth ``window`` are the deep inner nodes.
   All leaves below one but the first (smallest document, then place) are removed;
   unions of neighbouring ones are the maximal repeats.
   Words are compared as words; hashes only screen, route, and name rows.

Skew: equal suffixes of one batch meet before the shuffle and only their first
goes to the group, the others (known repeats) go back by document.  So a window
that a third of all rows hold reaches its group once a batch.

Memory of a task: its partition, which is kept to ``common.parts_for`` bytes of input by the number of
partitions, and the working arrays of one group.

Defined results: null text has no words; null doc_id sorts before all others;
identical rows get identical results; rows that share a doc_id but not the text
are parts of one document, each with its own places; a text may be of any length; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as w

WINDOW, GRAM, GROUP_SIZE, SLOT_BITS, SLICES = 20, 10, 500_000, 14, 16
#: An anchor slot is hot if it holds this many times the mean, and this many anchors at least.
HOT_TIMES, HOT_LEAST = 16, 5_000
_KNOWN, _TWICE, _PLACE = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)
_ANCHOR = np.dtype([("key", "<u8"), ("row", "<i8"), ("place", "<u4")])
_MARK = np.dtype([("row", "<i8"), ("place", "<u4")])
_RUN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("place", "<u4"), ("n", "<u4")])
_NULL_DOC = np.iinfo(np.int64).min


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + n] for every i that has n values."""
    have = 1
    while have * 2 <= n:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def _windows(text: w.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the hash of each one's anchor; then all grams' starts and hashes."""
    at, grams = text.runs(gram)
    starts, _ = text.runs(window)
    if not len(starts):
        return starts, np.empty(0, np.uint64), at, grams
    n = window - gram + 1
    lowest = _sliding(grams, n, np.minimum)
    return starts, lowest[np.searchsorted(at, starts)], at, grams


def _anchors(text: w.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and hashes of the grams that are some window's anchor."""
    starts, lowest, at, grams = _windows(text, window, gram)
    if not len(starts):
        return starts, lowest
    n = window - gram + 1
    of = np.zeros(len(grams) + n - 1, np.uint64)  # by gram, n - 1 places of padding before it
    of[np.searchsorted(at, starts) + n - 1] = lowest
    wanted = _sliding(of, n, np.maximum)[: len(grams)]  # the largest anchor hash of windows that reach here
    # windows of other texts may reach over: they can only name a larger hash, so each text is looked at by equality too
    is_anchor = wanted == grams
    doubtful = np.flatnonzero(wanted > grams)
    if len(doubtful):
        first = text.first[text.of()[at[doubtful]]]
        for k in range(n):
            back = doubtful - k
            ok = (back >= 0) & (at[np.maximum(back, 0)] >= first)
            is_anchor[doubtful] |= ok & (of[np.maximum(back, 0) + n - 1] == grams[doubtful])
    hit = np.flatnonzero(is_anchor)
    return at[hit], grams[hit]


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (w.mix(values.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by_row(packed: DataFrame, kind: np.dtype, parts: int) -> DataFrame:
    """One row for each row of documents that has marks: _of and its marks as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = common.unpack(batches, kind)
        r = r[np.lexsort((r["place"], r["row"]))]
        cut = np.flatnonzero(np.r_[True, r["row"][1:] != r["row"][:-1]]) if len(r) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(r)]
        for at in range(0, len(cut), 2000):
            blobs = [r[a:b].tobytes() for a, b in zip(cut[at : at + 2000], ends[at : at + 2000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["row"][cut[at : at + 2000]], pa.int64()), pa.array(blobs, pa.binary())], names=["_of", "_marks"])

    return packed.repartition(parts, "_bucket").mapInArrow(common.tidy(run), "_of long, _marks binary")


def _marks(b: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row of the batch and mark, of all marks."""
    own = [x or b"" for x in b.column("_marks").to_pylist()]
    return np.repeat(np.arange(len(own)), [len(x) // kind.itemsize for x in own]), np.frombuffer(b"".join(own), kind)


def _slots(parts: int) -> int:
    return 1 << min(20, max(SLOT_BITS, (16 * parts).bit_length()))


def _slot(anchor: np.ndarray, slots: int) -> np.ndarray:
    return (anchor >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def repeated_anchors(docs: DataFrame, parts: int, window: int, gram: int) -> tuple[DataFrame, np.ndarray]:
    """Step 1: places of repeated anchors by row; and how many anchors fall into each slot."""
    slots = _slots(parts)

    def sums(counts: np.ndarray) -> pa.RecordBatch:
        pieces = [x.tobytes() for x in counts.reshape(SLICES, -1)]
        return pa.RecordBatch.from_arrays([pa.array(range(-SLICES, 0), pa.int32()), pa.array(pieces, pa.binary())], names=["_bucket", "_blob"])

    def meet(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal anchors of a batch: the first goes by its hash, the others back to their rows."""
        r = r[np.lexsort((r["place"], r["row"], r["key"]))]
        once = np.ones(len(r), bool)
        once[1:] = (r["key"][1:] != r["key"][:-1]) | (r["row"][1:] != r["row"][:-1]) | (r["place"][1:] != r["place"][:-1])
        r = r[once]
        same, again = np.zeros(len(r), bool), np.zeros(len(r), bool)
        same[1:] = r["key"][1:] == r["key"][:-1]
        again[:-1] = same[1:]
        r["place"][again & ~same] |= _TWICE
        r["place"][same] |= _KNOWN
        return np.where(same, _bucket(r["row"], parts), (r["key"] % np.uint64(parts)).astype(np.int64)), r

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for b in batches:
            rows, found = b.column("_row").to_numpy(), []
            for at, _, data, offs in w.parts(b.column("text")):
                text = w.words(data, offs, w.SPACED, False)
                where, h = _anchors(text, window, gram)
                counts += np.bincount(_slot(h, slots), minlength=slots)
                of = text.of()[where]
                r = np.empty(len(where), _ANCHOR)
                r["key"], r["row"], r["place"] = h, rows[at + of], where - text.first[of]
                found.append(r)
            if found:
                buckets, r = meet(np.concatenate(found))
                yield from common.pack(buckets, parts, r)
        if counts.any():
            yield sums(counts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, blobs = {}, []
        for b in batches:
            for bucket, blob in zip(b.column("_bucket").to_pylist(), b.column("_blob").to_pylist(), strict=True):
                if bucket < 0:
                    counts[bucket] = counts.get(bucket, 0) + np.frombuffer(blob, np.int64)
                else:
                    blobs.append(np.frombuffer(blob, _ANCHOR))
        for bucket, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["_bucket", "_blob"])
        if not blobs:
            return
        r = np.concatenate(blobs)
        known = (r["place"] & _KNOWN) > 0
        own = r[~known]
        own = own[np.argsort(own["key"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, own["key"][1:] != own["key"][:-1]]) if len(own) else np.empty(0, np.int64)
        size = np.diff(np.r_[cut, len(own)])
        twice = np.logical_or.reduceat((own["place"] & _TWICE) > 0, cut) if len(own) else np.empty(0, bool)
        r = np.concatenate([own[np.repeat((size > 1) | twice, size)], r[known]])
        marks = np.empty(len(r), _MARK)
        marks["row"], marks["place"] = r["row"], r["place"] & _PLACE
        yield from common.pack(_bucket(marks["row"], parts), parts, marks)

    packed = docs.select("_row", "text").mapInArrow(common.tidy(scan), common.PACKED)
    found = common.materialise(packed.repartition(parts, "_bucket").mapInArrow(common.tidy(gather), common.PACKED), "anchors")
    counts = np.zeros((SLICES, slots // SLICES), np.int64)
    for row in found.filter("_bucket < 0").collect():  # a table of fixed size, in SLICES rows
        counts[row[0] + SLICES] += np.frombuffer(row[1], np.int64)
    common.drop_shuffles(docs.sparkSession)
    return found.filter("_bucket >= 0"), counts.ravel()


def prefix_groups(ids: np.ndarray, at: np.ndarray, most: int, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes (of the words ``ids``, from the places ``at``) in groups of at most ``most``, and how many words each group shares.

    A prefix with more suffixes is taken one word longer; small ones beside each other share a group.
    """
    todo = [(np.arange(len(at)), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= most or depth == window:
            yield own, depth
            continue
        word = ids[at[own] + depth]
        order = np.argsort(word, kind="stable")
        own, word = own[order], word[order]
        cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[cut, len(own)])
        big = size > most
        for k in np.flatnonzero(big):
            todo.append((own[cut[k] : cut[k] + size[k]], depth + 1))
        small = own[np.repeat(~big, size)]
        ends = np.cumsum(size[~big])
        begin = 0
        while begin < len(small):
            stop = int(ends[np.searchsorted(ends, begin + most, side="right") - 1])
            yield small[begin:stop], depth
            begin = stop


def deep_nodes(ids: np.ndarray, at: np.ndarray, own: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of suffixes ``own`` that share ``depth`` words, from its root down to depth ``window``.

    Returns the suffixes below its deep inner nodes and each one's node.  An edge's step is two words at a time; suffixes
    alone in their node are leaves above that depth and go no further.
    """
    node = np.zeros(len(own), np.int64)
    while depth < window and len(own):
        edge = ids[at[own] + depth].astype(np.int64) << 31
        if depth + 1 < window:
            edge |= ids[at[own] + depth + 1]
        order = np.lexsort((edge, node))
        own, node, edge = own[order], node[order], edge[order]
        new = np.ones(len(own), bool)
        new[1:] = (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])
        child = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        own, node = own[inner], child[inner]
        depth += 2
    return own, node


def repeats(ids: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int, most: int) -> np.ndarray:
    """For every suffix whether an equal window starts earlier."""
    under = np.zeros(len(at), bool)
    for group, depth in prefix_groups(ids, at, most, window):
        own, node = deep_nodes(ids, at, group, depth, window)
        if not len(own):
            continue
        order = np.lexsort((place[own], doc[own], node))
        own, node = own[order], node[order]
        first = np.maximum.accumulate(np.where(np.r_[True, node[1:] != node[:-1]], np.arange(len(own)), 0))
        under[own] = (doc[own] != doc[own[first]]) | (place[own] != place[own[first]])  # a repeated row is no repeat
    return under


def _met(h: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, start: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's windows: those to send to their group, and those known to be repeats of one that is sent."""
    order = np.lexsort((row, place, doc, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    i, j = order[~new], first[~new]
    for d in range(window):  # equal hashes, equal words?
        same = ids[start[i] + d] == ids[start[j] + d]
        if not same.all():
            i, j = i[same], j[same]
    known, sent = np.zeros(len(h), bool), np.ones(len(h), bool)
    known[i] = (doc[i] != doc[j]) | (place[i] != place[j])
    sent[i] = ~known[i] & (row[i] != row[j])  # a repeated row's window is sent once: marks go to every such row
    return sent, known


def _word_ids(blobs: list[bytes], most: int = 2 << 20) -> np.ndarray:
    """A number for every word of texts that end with white space; the texts are let go as they are read."""
    words, blobs[:] = [], blobs[::-1]
    while blobs:
        some, size = [], 0
        while blobs and (not some or size < most):
            some.append(blobs.pop())
            size += len(some[-1])
        data = np.frombuffer(b"".join(some), np.uint8)
        starts, ends = w.bounds(data, np.array([0, len(data)]), w.SPACED)
        at = np.r_[0, np.cumsum(ends - starts)]
        words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(w.gather(data, starts, ends - starts))]))
    return np.concatenate([c.indices.to_numpy() for c in pa.chunked_array(words, pa.large_binary()).dictionary_encode().chunks])


def _runs(pick: np.ndarray, start: np.ndarray, of: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Picked windows that follow each other in a text and to a bucket: index of the first, and how many."""
    at = np.flatnonzero(pick)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (start[at[1:]] != start[at[:-1]] + 1) | (of[at[1:]] != of[at[:-1]]) | (bucket[at[1:]] != bucket[at[:-1]])
    cut = np.flatnonzero(new)
    return at[cut], np.diff(np.r_[cut, len(at)])


_SENT = "_bucket int, _heads binary, _blob binary"


def removed_windows(placed: DataFrame, anchors: DataFrame, slots: np.ndarray, parts: int, window: int, gram: int, group_size: int) -> DataFrame:
    """Steps 2 and 3: by row, runs of windows that also start earlier."""
    hot = slots > max(HOT_LEAST, HOT_TIMES * slots.mean())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            row, mark = _marks(whole, _MARK)
            if not len(row):
                continue
            rows = np.unique(row)
            b = whole.take(pa.array(rows))
            row, place = np.searchsorted(rows, row), mark["place"]
            docs, names = b.column("_doc").to_numpy(), b.column("_row").to_numpy()
            for lo, hi, data, offs in w.parts(b.column("text")):
                text = w.words(data, offs, w.SPACED, False)
                start, lowest, grams_at, grams = _windows(text, window, gram)
                if not len(start):
                    continue
                mine = (row >= lo) & (row < hi)
                word = text.first[row[mine] - lo] + place[mine]
                word = word[word < text.first[row[mine] - lo + 1]]
                k = np.searchsorted(grams_at, word)
                wanted = np.isin(lowest, grams[k[k < len(grams)]])
                all_at, h = text.runs(window)
                h = h[np.searchsorted(all_at, start)][wanted]
                start, lowest = start[wanted], lowest[wanted]
                if not len(start):
                    continue
                of = text.of()[start]
                doc, name, at = docs[lo + of], names[lo + of], start - text.first[of]
                sent, known = _met(h, doc, name, at, start, w.names(data, text.starts, text.ends), window)
                route = np.where(hot[_slot(lowest, len(hot))], h, lowest)
                yield from _sent(data, text, window, doc, name, at, _runs(sent, start, of, to := _bucket(route, parts)), start, to, parts)
                first, n = _runs(known, start, of, of)
                runs = np.empty(len(first), _RUN)
                runs["doc"], runs["row"], runs["place"], runs["n"] = doc[first], name[first], at[first], n
                yield from _back(runs, parts)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, blobs = [], []
        for b in batches:
            for bucket, head, blob in zip(*(b.column(c).to_pylist() for c in ("_bucket", "_heads", "_blob")), strict=True):
                if blob is None:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([head], pa.binary())], names=["_bucket", "_blob"])
                else:
                    heads.append(np.frombuffer(head, _RUN))
                    blobs.append(blob)
        if not heads:
            return
        r = np.concatenate(heads)
        ids, n = _word_ids(blobs), r["n"].astype(np.int64)
        held = n + window - 1
        of = np.repeat(np.arange(len(r)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        doc, place = r["doc"][of], r["place"][of].astype(np.int64) + k
        under = repeats(ids, (np.cumsum(held) - held)[of] + k, doc, place, window, group_size)
        first, size = _runs(under, np.cumsum(held)[of] + k, of, of)
        out = np.empty(len(first), _RUN)
        out["doc"], out["row"], out["place"], out["n"] = doc[first], r["row"][of[first]], place[first], size
        for b in _back(out, parts):
            yield pa.RecordBatch.from_arrays([b.column("_bucket"), b.column("_heads")], names=["_bucket", "_blob"])

    packed = _joined(placed, _by_row(anchors, _MARK, parts)).select("_doc", "_row", "text", "_marks").mapInArrow(common.tidy(scan), _SENT)
    return _by_row(packed.repartition(parts, "_bucket").mapInArrow(common.tidy(subtrees), common.PACKED), _RUN, parts)


def _sent(data, text, window, doc, name, at, runs, start, bucket, parts) -> Iterator[pa.RecordBatch]:
    """Runs of windows with their words, a row a bucket."""
    first, n = runs
    if not len(first):
        return
    order = np.argsort(bucket[first], kind="stable")
    first, n = first[order], n[order]
    heads = np.empty(len(first), _RUN)
    heads["doc"], heads["row"], heads["place"], heads["n"] = doc[first], name[first], at[first], n
    begin, stop = text.starts[start[first]], text.ends[start[first] + n + window - 2]
    size = stop - begin + 1  # and one byte that parts it from the next
    blob = w.gather(np.r_[data, np.uint8(10)], begin, size)
    blob[np.cumsum(size) - 1] = 10
    own, cut = np.unique(bucket[first], return_index=True)
    ends, bytes_at = np.r_[cut[1:], len(first)], np.r_[0, np.cumsum(size)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([heads[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([blob[bytes_at[a] : bytes_at[b]].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
        names=["_bucket", "_heads", "_blob"],
    )


def _back(runs: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of removed windows on their way to their rows."""
    for b in common.pack(_bucket(runs["row"], parts), parts, runs):
        yield pa.RecordBatch.from_arrays([b.column("_bucket"), b.column("_blob"), pa.nulls(b.num_rows, pa.binary())], names=["_bucket", "_heads", "_blob"])


def _joined(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents with their marks."""
    return docs.join(marks, docs["_row"] == marks["_of"], "left").drop("_of")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_size: int = GROUP_SIZE, carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans removed (word from, to) and the text kept, its words joined by one space.

    ``carry`` names columns of docs that come along in the struct ``rest``; with ``verbatim``
    a text keeps its white space (that after a removed word goes with it), and a null stays null.
    """
    rest = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = common.parts_for(docs.select("doc_id", "text"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC))
    docs = docs.select("doc_id", "text", rest.alias("rest"), number.alias("_doc"), F.xxhash64("doc_id", "text").alias("_row"))
    anchors, slots = repeated_anchors(docs, parts, window, gram)
    placed = docs.repartition(parts, "_row")
    found = removed_windows(placed, anchors, slots, parts, window, gram, group_size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                of, marks = _marks(b, _RUN)
                starts, ends = w.bounds(data, offs, w.SPACED)
                first = np.searchsorted(starts, offs)
                mine = marks["doc"] == b.column("_doc").to_numpy()[of]
                of, marks = of[mine], marks[mine]
                word = first[of] + marks["place"]
                step = np.zeros(len(starts) + 1, np.int32)
                np.add.at(step, word, 1)
                np.add.at(step, word + marks["n"] + (window - 1), -1)
                gone = np.cumsum(step)[:-1] > 0
                sums = np.r_[0, np.cumsum(gone)]
                n_words, n_gone = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                raw, kept, spans = data.tobytes(), [], []
                for i, (a, z) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                    own = raw[offs[i] : offs[i + 1]]
                    edges = []
                    if n_gone[i]:
                        edges = np.flatnonzero(np.diff(np.r_[False, gone[a:z], False])).reshape(-1, 2).tolist()
                        if verbatim:
                            left, at = [], int(offs[i])
                            for x, y in edges:
                                left.append(raw[at : starts[a + x]])
                                at = int(starts[a + y]) if a + y < z else int(offs[i + 1])
                            own = b"".join([*left, raw[at : offs[i + 1]]])
                        else:
                            own = b" ".join([x for x, out in zip(own.split(), gone[a:z].tolist(), strict=True) if not out])
                    elif not verbatim:
                        own = b" ".join(own.split())
                    spans.append([{"start": x, "end": y} for x, y in edges])
                    kept.append(own)
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                if verbatim:
                    texts = pc.if_else(pc.is_null(b.column("text")), b.column("text"), texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, _SPANS), texts, b.column("rest")],
                    names=["doc_id", "n_words", "n_removed", "spans", "text", "rest"],
                )

    out = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string, rest {docs.schema['rest'].dataType.simpleString()}"
    done = _joined(placed, found).select("doc_id", "_doc", "text", "rest", "_marks").mapInArrow(common.tidy(cut), out)
    return done if carry else done.drop("rest")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
