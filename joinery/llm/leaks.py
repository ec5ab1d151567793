"""Benchmark decontamination with a generalised suffix automaton (operator 7).

The automaton of the normalised items' words recognises every run of words of
any item.  Training tokens stream through it; the state and the length of the
longest match are tracked word by word.  A length of ``window`` or more means that
the last ``window`` words are a window of an item, and the state's ancestor of that
depth names the items.  Items shorter than a window count as one window.

Before streaming, a screen over whole batches drops what cannot match: words, or
neighbouring word pairs, that no item has, by hash.  It loses nothing, and what
remains is matched by the words themselves.

Nothing of the benchmark comes to the driver or is broadcast.  Its items are cut into segments of at
most ``SEGMENT`` words that overlap by a window less one (so every window is in a segment), equal
segments are taken once, and segments are dealt by hash into blocks of about ``block_words`` words.
An executor builds each block's automaton and writes it to the shared folder; tasks read the blocks
one at a time (about 60 MB for 200,000 words), over at most ``HELD`` bytes of text.

Defined results: null or empty texts and items have no words; an item without
item_id counts under the id ''; equal items count each; a repeated item_id
counts once; documents are judged row by row, so ties and repeated rows get
equal results; an empty benchmark hits nothing, and an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as w
from .tokenfiles import file_system, local_uri, put

WINDOW, BLOCK_WORDS, SEGMENT, HELD = 10, 200_000, 20_000, 64 << 20
#: A document over this share of hit words goes; of others the spans go.
MAX_COVERAGE = 0.8
_TABLE = 1 << 20


class Automaton:
    """States are classes of word runs with equal ends: next, link and longest length; then the items of runs of a window's length."""

    def __init__(self, items: list[list[int]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long, self.window = [-1], [0], window
        for own in items:
            at = 0
            for word in own:
                at = self._add(at, word)
        n = len(self.link)
        order = sorted(range(n), key=self.long.__getitem__)
        self.deep = [-1] * n  # the state's ancestor, or itself, that holds its run of a window's length
        for v in order[1:]:
            up = self.deep[self.link[v]]
            self.deep[v] = up if up >= 0 else (v if self.long[v] >= window else -1)
        self.items: dict[int, set[int]] = {}
        whole: dict[int, set[tuple[int, int]]] = {}
        for i, own in enumerate(items):
            at = 0
            for word in own:  # the item's prefixes, now that no state will be split: one entry a place at most
                at = self.next[at][word]
                if self.deep[at] >= 0:
                    self.items.setdefault(self.deep[at], set()).add(i)
            if 0 < len(own) < window:
                whole.setdefault(at, set()).add((len(own), i))
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        if whole:
            for v in order[1:]:
                if got := self.short.get(self.link[v], ()) + tuple(whole.get(v, ())):
                    self.short[v] = got

    def _add(self, last: int, word: int) -> int:
        """The state of the run that ends with ``word``, after the run of ``last``."""
        got = self.next[last].get(word)
        if got is not None and self.long[got] == self.long[last] + 1:
            return got
        if got is not None:
            return self._split(last, word, got)
        new = self._state(self.long[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            old = self.next[at][word]
            self.link[new] = old if self.long[old] == self.long[at] + 1 else self._split(at, word, old)
        return new

    def _state(self, long: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.long.append(long)
        self.link.append(0)
        return len(self.long) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """A state of its own for the shorter runs of ``old``, those that follow ``at``."""
        new = self._state(self.long[at] + 1, dict(self.next[old]))
        self.link[new], self.link[old] = self.link[old], new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def stream(self, tokens: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Marks words of matches in ``hit`` and adds their items to ``found``."""
        state = length = 0
        nexts, links, longs, deep, short, window = self.next, self.link, self.long, self.deep, self.short, self.window
        for i, word in enumerate(tokens):
            while state and word not in nexts[state]:
                state = links[state]
                length = longs[state]
            to = nexts[state].get(word)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                hit[i + 1 - window : i + 1] = True
                found |= self.items[deep[state]]
            if short:
                for n, item in short.get(state, ()):
                    if n <= length:
                        hit[i + 1 - n : i + 1] = True
                        found.add(item)


class Block:
    """An automaton of segments, the item ids of each, and what is needed to leave out words that match nothing."""

    def __init__(self, segments: list[str], names: list[list[str]], window: int) -> None:
        data, offs = w.text_bytes(pa.array(segments, pa.string()))
        got = w.words(data, offs, w.PLAIN, True)
        own = [s.encode().split() for s in segments]
        self.ids: dict[bytes, int] = {}
        self.automaton = Automaton([[self.ids.setdefault(x, len(self.ids)) for x in ws] for ws in own], window)
        self.names = names
        self.least = min([min(window, len(x)) for x in own], default=0)
        self.words, self.pairs = np.zeros(_TABLE, bool), np.zeros(_TABLE, bool)
        self.words[self._slot(got.hashes)] = True
        self.pairs[self._slot(got.runs(2)[1])] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(44)).astype(np.int64)

    def mark(self, data: np.ndarray, text: w.Words, hit: np.ndarray, items: dict[int, set[str]]) -> None:
        """Marks hit words, and adds items by text."""
        if not self.least or not len(hit):
            return
        in_item = self.words[self._slot(text.hashes)]
        at, h = text.runs(2)
        joined = np.zeros(len(hit), bool)  # to the next word
        joined[at] = self.pairs[self._slot(h)]
        joined[:-1] &= in_item[:-1] & in_item[1:]
        begin = in_item.copy()
        begin[1:] &= ~joined[:-1]
        stop = in_item & ~joined
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = stop - begin >= self.least
        begin, stop = begin[long], stop[long]
        of = np.searchsorted(text.first, begin, side="right") - 1
        known, names = self.ids.get, self.names
        for a, b, t in zip(begin.tolist(), stop.tolist(), of.tolist(), strict=True):
            base = int(text.starts[a])
            raw = data[base : text.ends[b - 1]].tobytes().lower()  # of bytes: A-Z only
            own = [known(raw[x - base : y - base], -1) for x, y in zip(text.starts[a:b].tolist(), text.ends[a:b].tolist(), strict=True)]
            found: set[int] = set()
            self.automaton.stream(own, hit[a:b], found)
            if found:
                items.setdefault(t, set()).update(*(names[i] for i in found))


def blocks(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Paths of the blocks' files: as many as the benchmark has words for."""
    spark = benchmark.sparkSession
    folder = local_uri(common.scratch(spark, "automata"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                text, raw = w.words(data, offs, w.PLAIN, True), data.tobytes().lower()
                names, out, sizes = [], [], []
                ids = whole.column("item").slice(lo, hi - lo).to_pylist()
                for i, (a, z) in enumerate(zip(text.first.tolist(), text.first[1:].tolist(), strict=False)):
                    for at in range(a, max(z - window + 1, a + 1) if z > a else a, SEGMENT):
                        to = min(z, at + SEGMENT + window - 1)
                        out.append(b" ".join([raw[x:y] for x, y in zip(text.starts[at:to].tolist(), text.ends[at:to].tolist(), strict=True)]))
                        names.append(ids[i])
                        sizes.append(to - at)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["item", "words", "n"])

    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(common.tidy(cut), "item string, words string, n long")
    segments = common.materialise(own.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"), F.min("n").alias("n")), "segments")
    n_blocks = -(-(segments.agg(F.sum("n")).first()[0] or 0) // block_words)
    if not n_blocks:
        return []

    def build(some: pa.Table) -> pa.Table:
        some = some.take(pc.sort_indices(some, [("words", "ascending")]))
        block = Block(some.column("words").to_pylist(), some.column("items").to_pylist(), window)
        path = put(folder, f"block-{uuid.uuid4().hex}", pickle.dumps(block, pickle.HIGHEST_PROTOCOL))
        return pa.table([pa.array([path])], names=["path"])

    dealt = segments.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    built = common.materialise(dealt.groupBy("block").applyInArrow(build, "path string"), "blocks")
    return sorted(r.path for r in built.collect())  # a row a block


_read: dict[str, Block] = {}


def _block(path: str) -> Block:
    """A block's file; a worker keeps the last one."""
    if path not in _read:
        _read.clear()
        fs, at = file_system(path)
        with fs.open_input_stream(at, compression=None) as stream:
            _read[path] = pickle.loads(stream.read())
    return _read[path]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """Slices of batches with their texts' bytes and offsets, in groups of about ``most`` bytes."""
    held, size = [], 0
    for whole in batches:
        for lo, hi, data, offs in w.parts(whole.column("text")):
            held.append((whole.slice(lo, hi - lo), data, offs))
            size += len(data)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(hit: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of hit words of every text, counted from its first word."""
    n = len(hit)
    inner = first[(first > 0) & (first < n)]
    begin, stop = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    begin[inner] = hit[inner]
    stop[:-1] &= ~hit[1:]
    stop[inner - 1] = hit[inner - 1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    base = first[np.searchsorted(first, begin, side="right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(stop - base, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, first), pa.int32()), spans)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, columns to carry, n_words, items (array of item ids), spans of hit words (from, to) of every document."""
    kept = ["doc_id", "text", *carry]
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    paths = blocks(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _held(batches, HELD if len(paths) > 1 else 1):
            firsts, hits, items = [], [], [{} for _ in group]
            for k, path in enumerate(paths or [None]):
                for i, (_, data, offs) in enumerate(group):
                    text = w.words(data, offs, w.PLAIN, True)
                    if not k:
                        firsts.append(text.first)
                        hits.append(np.zeros(len(text.hashes), bool))
                    if path:
                        _block(path).mark(data, text, hits[i], items[i])
            for (b, _, _), first, hit, found in zip(group, firsts, hits, items, strict=True):
                names = pa.array([sorted(found.get(i, ())) for i in range(b.num_rows)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(np.diff(first), pa.int64()), names, _spans(hit, first)], names=[*kept, "n_words", "items", "spans"])

    return docs.select(*kept).mapInArrow(common.tidy(run), f"{own}, n_words long, items array<string>, spans array<struct<start:int,end:int>>")


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark).select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents without benchmark passages: hit words are cut out; documents hit over ``max_coverage`` go.

    Returns doc_id, text and the columns to carry.  Cutting removes the bytes from the first to the last hit
    word of a span; texts without hits stay as they are.
    """
    kept = ["doc_id", *carry]
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                spans, texts = b.column("spans").to_pylist(), b.column("text")
                hit = [i for i, s in enumerate(spans) if s]
                if hit:
                    texts = texts.to_pylist()
                    text, raw = w.words(data, offs, w.PLAIN, True), data.tobytes()
                    for i in hit:
                        at, left = int(offs[i]), []
                        for s in spans[i]:
                            left.append(raw[at : text.starts[text.first[i] + s["start"]]])
                            at = int(text.ends[text.first[i] + s["end"] - 1])
                        left.append(raw[at : offs[i + 1]])
                        texts[i] = b"".join(left).decode("utf-8", "replace")
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*map(b.column, kept), texts], names=[*kept, "text"])

    found = find(docs, benchmark, carry=carry)
    found = found.filter((_n_hit() == 0) | (_n_hit() <= F.col("n_words") * max_coverage))
    return found.select(*kept, "text", "spans").mapInArrow(common.tidy(run), f"{own}, text string")
