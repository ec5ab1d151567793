"""Token ids in files of Simple-8b words (operator 2).

A word has a 4-bit selector and 60 bits of data: selector 0 and 1 stand for
240 and 120 zeros, 2 to 15 for n ids of 60 / n bits.  An id over 60 bits
is an *escape*: the block keeps it aside, and the words hold 0 in its place.

File: magic, counts of documents, ids, blocks and words; doc_id, a null flag and
number of ids of every document; then per block of ``BLOCK`` ids the number of words (so each
block's offset) and of escapes; the words; the escapes (place, value).  All little-endian.
Blocks are packed and unpacked side by side, one numpy step for all blocks.

Documents are ordered by doc_id (null first; rows that share one by a hash of the text)
over range partitions; each writes files of up to ``MAX_IDS`` ids under names of its own attempt.
Only files that a finished task reports are read, so what a lost or doubled attempt left is never seen.

Defined results: null text is empty; an empty text has the end id alone; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

BLOCK, END_ID, MAGIC = 1024, 0, b"S8BT0001"
#: Ids a word and bits an id, by selector: fixed values of Simple-8b.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words per block, and escapes (place, value) of unsigned 64-bit ids."""
    n = len(ids)
    ids = ids.astype(_U)
    big = np.flatnonzero(ids >= _U(1 << 60))
    escapes = np.stack([big.astype(_U), ids[big]], 1)
    if len(big):
        ids = ids.copy()
        ids[big] = 0
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 240), _U)
    padded = np.zeros(blocks * BLOCK, _U)
    padded[:n] = ids
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    # the selector of the most ids that fit, at every place: by the least bits that hold an id, and the most of that over 1, 2, 4 ... ids
    classes = np.unique(BITS)
    need = np.zeros(grid.shape, np.uint8)
    need[:, :BLOCK] = np.searchsorted((1 << classes.astype(_U)) - _U(1), padded).astype(np.uint8).reshape(blocks, BLOCK)
    runs = [need]
    while 2 << (len(runs) - 1) <= COUNTS[0]:
        have = 1 << (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:, :-have], runs[-1][:, have:]))
    selector = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        own = runs[int(COUNTS[s]).bit_length() - 1]
        k = COUNTS[s] - (1 << (int(COUNTS[s]).bit_length() - 1))
        fits = np.maximum(own[:, :BLOCK], own[:, k : k + BLOCK]) <= np.searchsorted(classes, BITS[s])
        selector[fits] = s
    sizes = np.full(blocks, BLOCK)
    if n % BLOCK:
        sizes[-1] = n % BLOCK
    at, steps = np.zeros(blocks, np.int64), []
    live = np.arange(blocks)
    while len(live):  # a word of every block that has ids left
        steps.append(np.full(blocks, -1, np.int64))
        steps[-1][live] = at[live]
        at[live] += COUNTS[selector[live, at[live]]]
        live = live[at[live] < sizes[live]]
    picked = np.stack(steps, 1) if steps else np.empty((0, 0), np.int64)
    row, step = np.nonzero(picked >= 0)
    place = picked[row, step]
    chosen = selector[row, place] if len(row) else np.empty(0, np.uint8)
    words = chosen.astype(_U) << _U(60)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= grid[row[mine], place[mine] + k] << _U(k * BITS[s])
    return words, np.bincount(row, minlength=blocks).astype(np.uint32), escapes


def unpack(words: np.ndarray, per_block: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """Ids again.  Each word's place follows from its block's offset and the counts before it."""
    chosen = (words >> _U(60)).astype(np.int64)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(per_block)), per_block)
    firsts = np.r_[0, np.cumsum(per_block)[:-1]].astype(np.int64)[block] if len(words) else np.empty(0, np.int64)
    place = block * BLOCK + before - before[firsts]
    ids = np.zeros(len(per_block) * BLOCK + 240, _U)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        mask = _U((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s] if len(mine) else 0):
            value = words[mine] >> _U(k * BITS[s]) & mask
            ids[place[mine] + k] |= value  # past a block's end the padding is 0
    ids = ids[:n]
    if len(escapes):
        ids[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return ids


def to_file(docs: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    packed = [pack(ids[i : i + BLOCK * 1024]) for i in range(0, len(ids), BLOCK * 1024)]
    words = np.concatenate([p[0] for p in packed]) if packed else np.empty(0, _U)
    per_block = np.concatenate([p[1] for p in packed]) if packed else np.empty(0, np.uint32)
    for k, p in enumerate(packed):
        p[2][:, 0] += _U(k * BLOCK * 1024)
    escapes = np.concatenate([p[2] for p in packed]) if packed else np.empty((0, 2), _U)
    head = np.array([len(docs), len(ids), len(per_block), len(words), len(escapes)], "<u8")
    return b"".join(x.tobytes() for x in (np.frombuffer(MAGIC, np.uint8), head, docs.astype("<i8"), nulls.astype(np.uint8), sizes.astype("<u8"), per_block.astype("<u4"), words.astype("<u8"), escapes.astype("<u8")))


def from_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, null flags, sizes and ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_words, n_escapes = np.frombuffer(raw, "<u8", 5, 8).tolist()
    at, out = 48, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_blocks), ("<u8", n_words), ("<u8", 2 * n_escapes)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    docs, nulls, sizes, per_block, words, escapes = out
    ids, ends, step = np.empty(n_ids, _U), np.r_[0, np.cumsum(per_block, dtype=np.int64)], 1024
    for k in range(0, n_blocks, step):
        a, b = k * BLOCK, min(n_ids, (k + step) * BLOCK)
        ids[a:b] = unpack(words[ends[k] : ends[min(n_blocks, k + step)]], per_block[k : k + step], b - a, np.empty((0, 2), _U))
    escapes = escapes.reshape(-1, 2)
    if len(escapes):
        ids[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return docs, nulls.astype(bool), sizes.astype(np.int64), ids


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def put(folder: str, name: str, content: bytes) -> str:
    """Write under a name of this attempt's own, then move."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(content)
    fs.move(own, f"{at}/{name}")
    return f"{folder}/{name}"


def local_uri(uri: str) -> str:
    """file:/x as file:///x."""
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


#: Ids buffered before a partition's file is closed and the next begun (40 MB of ids).
MAX_IDS = 10_000_000
#: Bytes of text that are encoded together: the more, the fewer pieces are looked up again.
SLICE = 16 << 20


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write.  Returns one row a file: part, seq, path, n_docs, n_ids; the order is (part, seq)."""
    parts = common.shuffle_parts(docs.sparkSession)
    folder = local_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context, seq = bpe.loaded("library", tokenizer), TaskContext.get(), 0
        part, attempt = context.partitionId(), context.taskAttemptId()
        names, sizes, parts, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, sizes, parts, held, seq
            if names:
                nulls, n = np.array([x is None for x in names]), np.concatenate(sizes)
                content = to_file(np.array([x or 0 for x in names], np.int64), nulls, n, np.concatenate(parts))
                path = put(folder, f"part-{part:06d}-{seq:04d}-{attempt}.s8b", content)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, seq, path, len(names), int(n.sum()))], names=["part", "seq", "path", "n_docs", "n_ids"])
                names, sizes, parts, held, seq = [], [], [], 0, seq + 1

        for piece, data, offs in bpe.text_slices(bpe.gathered(batches, SLICE), "text", SLICE):
            ids, at = own.encode(data, offs)
            names += piece.column("doc_id").to_pylist()
            sizes.append(np.diff(at) + 1)
            parts.append(np.insert(ids, at[1:], end_id).astype("<u4"))
            held += len(parts[-1])
            if held >= MAX_IDS:
                yield from flush()
        yield from flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    own = own.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return own.mapInArrow(common.tidy(run, True), "part long, seq long, path string, n_docs long, n_ids long")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of files given as path, first (the ids before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    docs, nulls, sizes, ids = from_file(stream.read())
                ends = np.r_[0, np.cumsum(sizes)]
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(docs), 2000):
                    e = ends[k : k + 2001]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[k : k + 2000], pa.int64(), mask=nulls[k : k + 2000]),
                            pa.array(first + e[:-1], pa.int64()),
                            pa.array(np.diff(e), pa.int64()),
                            pa.array([raw[4 * i : 4 * j] for i, j in zip(e, e[1:], strict=False)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.select("path", "first").mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def manifest(files: DataFrame) -> DataFrame:
    """path and first (the ids before it) of every file, in as many partitions as were written.

    Sums go part by part (a row a partition, in one window), then file by file within a part; nothing is collected.
    """
    total = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = total.select("part", before(Window.orderBy("part"), "n").alias("base"))
    placed = files.join(bases, "part").withColumn("own", before(Window.partitionBy("part").orderBy("seq"), "n_ids"))
    return placed.select("path", (F.col("base") + F.col("own")).alias("first")).repartition(common.shuffle_parts(files.sparkSession), "path")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    files = common.materialise(write(docs, tokenizer, common.scratch(spark, "tokens")), "files", bpe.BATCH)
    return read(manifest(files)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
