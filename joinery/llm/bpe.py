"""BPE encoding by a prefix-sharing trie walk, and decoding (operator 8); piece cache for operator 2.

Method: the distinct words of a batch are inserted into a byte trie (kept as
the sorted word list, whose neighbours' common prefixes are the trie's shared
paths) and walked depth first.  A node's state is the *last token* of its
prefix's encoding; it follows from the states above it: token ``t`` ends the
prefix if ``t`` is a suffix of it and the state ``u`` before ``t`` and ``t``
stay apart when merged.  So every shared prefix is encoded once.  The tokens that
end a prefix come from a second trie, over the vocabulary, with links to the
longest proper suffix that is in it: a step of the walk is a step there.

Texts are cut before single spaces (``cuts``), equal chunks are found by Arrow's
dictionary encoding, the split pattern runs over the distinct ones only, and ids
of texts are gathered in numpy; per word of text no Python runs.

Memory of a worker: a slice of ``SLICE`` bytes of text (one text at least) with its ids,
``MAX_CACHED`` pieces, and ``MAX_PAIRS`` remembered pairs and steps.

Defined results: null text is empty; empty text has no ids; identical rows
give identical rows; columns other than those named are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: The split pattern and the byte alphabet of byte-level BPE: fixed values of the public format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds a Python worker: bytes of text at once, cached pieces (about 40 MB, twice that where the library encodes, in two halves: the older is dropped when the other is full), remembered pairs and steps (20 MB each).
SLICE, MAX_CACHED, MAX_PAIRS = 2 << 20, 200_000, 200_000


def _alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Tables of one tokenizer file, and the walk."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        of = _alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in vocab.items() if s not in self.special}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.lengths = list(map(len, self.bytes))
        sizes = np.array(self.lengths, np.int32)
        self.table = sizes, (np.cumsum(sizes) - sizes).astype(np.int32), np.frombuffer(b"".join(self.bytes), np.uint8)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids: rank, merged id
        self.halves: dict[int, tuple[int, int, int]] = {}  # merged id: left, right, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[raw(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            c = self.ids[self.bytes[a] + self.bytes[b]]
            self.merge.setdefault((a, b), (rank, c))
            self.halves.setdefault(c, (a, b, rank))
        self._apart: dict[int, bool] = {}  # by u * size + t
        self._whole: dict[int, bool] = {}
        self._step: dict[int, int] = {}
        self._grow()

    def _grow(self) -> None:
        """The vocabulary as a trie: edges by node and byte, each node's token, and its longest proper suffix in the trie."""
        self.edge: dict[int, int] = {}
        self.token, parents, edge = [-1], [(0, 0)], self.edge
        for word, i in self.ids.items():
            at = 0
            for byte in word:
                to = edge.get(at << 8 | byte)
                if to is None:
                    to = edge[at << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    parents.append((at, byte))
                at = to
            self.token[at] = i
        depth = np.zeros(len(parents), np.int64)
        for v in range(1, len(parents)):  # a parent is numbered before its children
            depth[v] = depth[parents[v][0]] + 1
        self.suffix = [0] * len(parents)
        for v in np.argsort(depth, kind="stable").tolist():
            if depth[v] > 1:
                up, byte = parents[v]
                self.suffix[v] = self.step(self.suffix[up], byte)
        self._ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(parents)

    def step(self, at: int, byte: int) -> int:
        """The node of the longest suffix of ``at`` and the byte that is in the vocabulary's trie."""
        key = at << 8 | byte
        to = self.edge.get(key)
        if to is None and (to := self._step.get(key)) is None:
            up = at
            while up and (up << 8 | byte) not in self.edge:
                up = self.suffix[up]
            to = self.edge.get(up << 8 | byte, 0)
            if len(self._step) >= MAX_PAIRS:
                self._step.clear()
            self._step[key] = to
        return to

    def ending(self, at: int) -> tuple[tuple[int, int], ...]:
        """Tokens, with their lengths, that end here and encode to themselves; the longest first."""
        got = self._ending[at]
        if got is None:
            out, up = [], at
            while up:
                if self.token[up] >= 0 and self.whole(self.token[up]):
                    out.append((self.token[up], len(self.bytes[self.token[up]])))
                up = self.suffix[up]
            got = self._ending[at] = tuple(out)
        return got

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left."""
        out = [self.ids[bytes([b])] for b in word]
        while len(out) > 1:
            rank, at = min((self.merge.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == 1 << 60:
                break
            out[at : at + 2] = [self.merge[out[at], out[at + 1]][1]]
        return out

    def whole(self, t: int) -> bool:
        """Whether the token's bytes encode to that token alone."""
        if t not in self._whole:
            self._whole[t] = self.merged(self.bytes[t]) == [t]
        return self._whole[t]

    def apart(self, u: int, t: int) -> bool:
        """Whether u, t, which encode to themselves, are the encoding of their joined bytes: no merge ever crosses the border."""
        key = u * self.size + t
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) >= MAX_PAIRS:
                self._apart.clear()
            got = self._apart[key] = self._stay(u, t)
        return got

    def _stay(self, u: int, t: int) -> bool:
        """Undo merges beside the border, latest first, looking for a pair that would have merged before them.

        Of two halves the one merged later is undone first; the pair exposed must not
        merge before that undone merge happens (a left neighbour wins a tie of ranks).
        """
        left, right = self.halves.get(u, (0, 0, -1)), self.halves.get(t, (0, 0, -1))
        until_left = until_right = 1 << 60  # ranks at which what is left, right of the border is merged away
        while True:
            got = self.merge.get((u, t))
            if got is not None:
                # it would take place unless its left or its right part was taken before
                if got[0] < until_left and got[0] <= until_right:
                    return False
            if left[2] < 0 and right[2] < 0:
                return True
            if left[2] > right[2]:
                until_left, u = left[2], left[1]
                left = self.halves.get(u, (0, 0, -1))
            else:
                until_right, t = right[2], right[0]
                right = self.halves.get(t, (0, 0, -1))

    def walk(self, own: list[bytes]) -> list[bytes]:
        """Encodings, as little-endian 32-bit ids, of distinct sorted words; their trie depth first."""
        out, edge, step, ending_of, ending, known, apart, size = [], self.edge.get, self.step, self._ending, self.ending, self._apart.get, self.apart, self.size
        path, last, nodes = b"", [-1], [0]  # the trie node we stand on; of each node above it the state and the vocabulary's node
        lengths = self.lengths
        for word in own:
            at, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                at = most
            else:
                while word[at] == path[at]:
                    at += 1
            del last[at + 1 :], nodes[at + 1 :]
            node, end = nodes[-1], at
            for byte in word[at:]:
                end += 1
                to = edge(node << 8 | byte)
                node = step(node, byte) if to is None else to
                nodes.append(node)
                for t, n in ending_of[node] or ending(node):
                    if n == end:
                        break
                    u = last[end - n]
                    ok = known(u * size + t)
                    if ok or ok is None and apart(u, t):
                        break
                last.append(t)
            path, end, tokens = word, len(word), []
            while end:
                t = last[end]
                tokens.append(t)
                end -= lengths[t]
            tokens.reverse()
            out.append(array("I", tokens).tobytes())
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of the split pattern."""
        own = sorted({p.encode() for p in pieces if p not in self.special})
        got = dict(zip(own, self.walk(own), strict=True))
        return [array("I", [self.special[p]]).tobytes() if p in self.special else got[p.encode()] for p in pieces]

    def decode(self, flat: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of lists of ids: bytes of tokens side by side; what is not UTF-8 becomes U+FFFD."""
        sizes, starts, data = self.table
        n = sizes[flat]
        raw = words.gather(data, starts[flat], n)
        ends = np.r_[0, np.cumsum(n, dtype=np.int64)][offs]
        del n
        inner = ends[:-1][ends[:-1] < len(raw)]
        try:
            raw.tobytes().decode()
            split = bool(((raw[inner] & 0xC0) == 0x80).any())  # a text that begins inside a character
        except UnicodeDecodeError:
            split = True
        if split:
            whole = raw.tobytes()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


class LibraryBPE:
    """The tokenizers library over many pieces at once.

    Pieces that begin with a space go in joined texts, as one's end says nothing about the next;
    their ids are told apart by the byte lengths of tokens.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.sizes = np.zeros(1 + max([*vocab.values(), *self.special.values()]), np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # a character of the format stands for a byte

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        spaced = [i for i, p in enumerate(pieces) if p[0] == " " and not p.isspace() and p not in self.special]
        out: list[bytes | None] = [None] * len(pieces)
        if spaced:
            own = [pieces[i] for i in spaced]
            joined = self._encoded(["".join(own[i : i + 1000]) for i in range(0, len(own), 1000)])
            flat = np.concatenate([np.array(x, "<u4") for x in joined])
            ends = np.cumsum(pc.binary_length(pa.array(own, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.cumsum(self.sizes[flat])
            last = np.minimum(np.searchsorted(at, ends), len(at) - 1)
            if (at[last] == ends).all():  # else the file has steps that make pieces depend on each other
                raw, stops = flat.tobytes(), (4 * (last + 1)).tolist()
                for i, a, b in zip(spaced, [0, *stops], stops, strict=False):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._encoded([pieces[i] for i in rest]), strict=True):
            out[i] = array("I", ids).tobytes()
        return out


#: White space beyond ASCII in UTF-8: two-byte and three-byte forms, fixed values of Unicode.
_WIDE_2 = (0xC285, 0xC2A0)
_WIDE_3 = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)


def _white(padded: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether white space ends just before ``at``, or begins there; ``padded`` has 3 bytes more on both sides."""
    one = padded[at - 1 if before else at]
    out = ((one >= 9) & (one <= 13)) | ((one >= 0x1C) & (one <= 0x20))
    odd = np.flatnonzero(one >= 0x80)
    byte = lambda k: padded[at[odd] + k].astype(np.int64)
    two, three = ((-2, -1), (-3, -2, -1)) if before else ((0, 1), (0, 1, 2))
    out[odd] = np.isin(byte(two[0]) << 8 | byte(two[1]), _WIDE_2) | np.isin(byte(three[0]) << 16 | byte(three[1]) << 8 | byte(three[2]), _WIDE_3)
    return out


def _padded(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 6, np.uint8)
    out[3:-3] = data
    return out


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of chunks: of texts, and single spaces between two characters that are not white space.

    Such a space always begins a word of the split pattern, and nothing before it looks behind it.
    """
    n, padded = len(data), _padded(data)
    at = np.flatnonzero(data == 0x20) + 3
    at = at[~(_white(padded, at, True) | _white(padded, at + 1, False))]
    mask = np.zeros(n + 1, bool)
    mask[at - 3] = True
    mask[np.maximum(offs[1:] - 1, 0)] = False  # a text's last byte
    mask[offs[:-1]] = True
    return np.flatnonzero(mask[:n])


class Chunked:
    """Ids of whole texts from cached ids of the pieces of their distinct chunks."""

    def __init__(self, encoder, most: int = MAX_CACHED) -> None:
        import regex

        self.encoder, self.most, self.known, self.former = encoder, most, {}, {}
        self._pattern = regex.compile(PATTERN)
        special = "|".join(regex.escape(s) for s in sorted(encoder.special, key=len, reverse=True))
        self._special = regex.compile(f"({special})") if special else None

    def _split(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._pattern.findall(text)
        return [x for k, p in enumerate(self._special.split(text)) for x in ([p] if k % 2 else self._pattern.findall(p))]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.most // 2:  # what comes again is taken over from the former half
            self.former, self.known = self.known, {}
        known, former = self.known, self.former
        out = [known.get(p) or former.get(p) for p in pieces]
        new = [p for p, x in zip(pieces, out, strict=True) if x is None]
        own = dict(zip(new, self.encoder.encode_pieces(new), strict=True)) if new else {}
        out = [own[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
        known.update(own if len(own) <= self.most // 2 else list(own.items())[: self.most // 2])
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts side by side, and each text's offset among them."""
        starts = cuts(data, offs)
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(offs), np.int64)
        ends = np.r_[starts, len(data)]
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which, distinct = chunks.indices.to_numpy(), chunks.dictionary
        del chunks, ends
        raw, at = words.text_bytes(distinct)
        # chunks that begin with a space and do not end in white space may stand side by side
        plain = (raw[at[:-1]] == 0x20) & ~_white(_padded(raw), at[1:] + 3, True)
        sizes = np.diff(at)[plain]
        places = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        pieces = self._split(words.gather(raw, at[:-1][plain], sizes).tobytes().decode())
        more = [0]
        for own in map(self._split, distinct.filter(pa.array(~plain)).to_pylist()):
            pieces += own
            more.append(len(own))
        named = pa.array(pieces, pa.string()).dictionary_encode()
        del pieces, distinct, raw
        index = named.indices.to_numpy()
        # of each chunk, in order of places, its first piece
        width = pc.binary_length(named.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[index]
        first = np.searchsorted(np.r_[0, np.cumsum(width)], np.r_[0, np.cumsum(sizes)])
        first = np.r_[first[:-1], first[-1] + np.cumsum(more)]
        blobs = self._ids(named.dictionary.to_pylist())
        flat, n = np.frombuffer(b"".join(blobs), "<u4"), np.array(list(map(len, blobs)), np.int64) // 4
        flat = words.gather(flat, (np.cumsum(n) - n)[index], n[index])  # ids of the distinct chunks in order of places
        before = np.r_[0, np.cumsum(n[index])][first]
        order = np.empty(len(places), np.int32)
        order[places] = np.arange(len(places), dtype=np.int32)
        which = order[which]
        sizes = np.diff(before)[which]
        total = np.r_[0, np.cumsum(sizes)]
        return words.gather(flat, before[which], sizes), total[np.searchsorted(starts, offs)]


def loaded(kind: str, path: str):
    """One encoder a Python worker; kept between tasks, until one that encodes nothing.  Encoder and decoder share their tables."""
    if (kind, path) not in common.kept:
        common.kept[kind, path] = TrieBPE(path) if kind == "tables" else Chunked(LibraryBPE(path), 2 * MAX_CACHED) if kind == "library" else Chunked(loaded("tables", path))
    return common.kept[kind, path]


def text_slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in slices of about ``most`` bytes of text, with their bytes and offsets (null: empty)."""
    for b in batches:
        for at, to, data, offs in words.parts(b.column(name), most):
            yield b.slice(at, to - at), data, offs


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined to ones of about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded("trie", tokenizer)
        for piece, data, offs in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _lists(*own.encode(data, offs))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = loaded("tables", tokenizer)
        for whole in batches:
            ends, at = whole.column("ids").offsets.to_numpy(), 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE // 4, side="right")) - 1)
                b = whole.slice(at, min(to, whole.num_rows) - at)
                at += b.num_rows
                lists = b.column("ids")
                flat, offs = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, tables.decode(flat, offs - offs[0])], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.tidy(run, True), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, in one pass of one worker, which holds one set of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = loaded("trie", tokenizer), loaded("tables", tokenizer)
        for piece, data, offs in text_slices(gathered(batches, SLICE), "text"):
            ids, at = own.encode(data, offs)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _lists(ids, at), tables.decode(ids, at)], names=["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


#: Rows of an Arrow batch of texts, where a step is written.
BATCH = 1000


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Written at once, so that batches of long texts can be bounded; the table is of digests, and small.
    """
    own = round_trip(docs, tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
    return common.materialise(own, "digests", BATCH)
