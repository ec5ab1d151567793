"""Normalised records, blocking keys, candidates and retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import vocabulary as v
from ..sources import store
from . import cosine

BITS = {k: i for i, k in enumerate("ABCDEFGHIJKL")}


def normalise(records: DataFrame, canonical: bool = False) -> DataFrame:
    """id, src, country and the views of name and address, in one projection; ``canonical`` gives core, addr_norm and house their canonical forms."""
    own = records.withColumn("_name", F.lower(x.to_ascii(F.col("business_name")))).withColumn("_addr", F.lower(x.to_ascii(F.col("business_address"))))
    own = own.withColumn("name_norm", x.clean(x.scrub(F.col("_name"))))
    own = own.withColumn("core", x.canonical_core(F.col("name_norm")) if canonical else x.drop_words(F.col("name_norm"), v.LEGAL))
    own = own.withColumn("skel", x.drop_words(x.skeleton(F.col("core")), x.LEGAL_SKELETONS)).withColumn("concat", F.regexp_replace("core", " ", ""))
    own = own.withColumn("addr_norm", x.clean(F.col("_addr")))
    own = own.withColumn("addr_norm", x.canonical_address(F.col("addr_norm"))) if canonical else own
    own = own.withColumn("addr_tok", x.address_tokens(F.col("addr_norm")))
    own = own.withColumn("postcode", x.postcode(F.col("_addr"))).withColumn("house", x.house(F.col("_addr"), F.col("postcode"), units=not canonical))
    return own.select(F.col("entity_id").alias("id"), "src", "country", "name_norm", "core", "skel", "concat", "addr_norm", "addr_tok", "postcode", "house")


def document_frequency(records: DataFrame, view: str) -> DataFrame:
    """tok, df: records that have the token, each counted once."""
    return records.select(F.explode(F.array_distinct(x.tokens(F.col(view)))).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def rarest(records: DataFrame, view: str, n: int = 3) -> DataFrame:
    """id and its n rarest tokens r1..rn (ties by letters), null where there are fewer."""
    own = records.select("id", F.explode(F.array_distinct(x.tokens(F.col(view)))).alias("tok")).join(document_frequency(records, view), "tok")
    # a record has few tokens: its sorted list is one small value
    ranked = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r"))
    return ranked.select("id", *[F.get("r", F.lit(i))["tok"].alias(f"r{i + 1}") for i in range(n)])


def _key(kind: str, *parts: Column) -> Column:
    """Null if a part is missing."""
    return F.struct(F.lit(kind).alias("kind"), F.concat(F.col("country"), *[c for p in parts for c in (F.lit("|"), p)]).alias("key"))


def blocking_keys(records: DataFrame, rescue: bool = False) -> DataFrame:
    """id, src, kind, key: the long table of all keys, null keys left out."""
    names = rarest(records, "skel").toDF("id", "n1", "n2", "n3")
    places = rarest(records, "addr_tok").toDF("id", "a1", "a2", "a3")
    own = records.join(names, "id", "left").join(places, "id", "left")
    c, pair = F.col, lambda p, q: (F.least(p, q), F.greatest(p, q))
    full = lambda p, q, k: F.when(c(q).isNotNull(), k)
    keys = [
        full("n1", "n2", _key("A", *pair("n1", "n2"))), _key("B", c("n1"), c("postcode")), _key("C", c("n1"), c("a1")),
        F.when(F.length("concat") >= 4, _key("D", F.substring("concat", 1, 8))), _key("E", c("n1")), _key("F", c("postcode"), c("house")), _key("G", c("a1"), c("house")),
    ]
    if rescue:
        keys += [full(p, q, _key("H", *pair(p, q))) for p, q in (("a1", "a2"), ("a1", "a3"), ("a2", "a3"))] + [_key("I", c(n)) for n in ("n1", "n2", "n3")]
    long = own.select("id", "src", F.explode(F.array(*keys)).alias("k")).select("id", "src", "k.kind", "k.key")
    return long.filter("key is not null").distinct()


def numeric_keys(records: DataFrame) -> DataFrame:
    """id, src, kind, key: country, a number and every token of two letters or more: J house and name skeleton, K house and address token, L postcode and name skeleton."""
    out = None
    for kind, view, number in (("J", "skel", "house"), ("K", "addr_tok", "house"), ("L", "skel", "postcode")):
        own = records.filter(F.coalesce(number, F.lit("")) != "").select("id", "src", "country", F.col(number).alias("num"), F.explode(F.array_distinct(x.tokens(F.col(view)))).alias("tok")).filter(F.length("tok") >= 2)
        one = own.select("id", "src", F.lit(kind).alias("kind"), F.concat("country", F.lit("|"), "num", F.lit("|"), "tok").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def alternative_keys(records: DataFrame) -> DataFrame:
    """id, src, kind, key: H two rarest address tokens, I postcode and rarest, J second and house, K first skeleton token and house, L house, first letter and last address token."""
    places = rarest(records, "addr_tok", 2).toDF("id", "a1", "a2")
    own = records.join(places, "id", "left")
    c, given = F.col, lambda n: F.nullif(F.col(n), F.lit(""))
    first, last = F.get(x.tokens(c("skel")), F.lit(0)), F.try_element_at(x.tokens(c("addr_tok")), F.lit(-1))
    keys = [
        _key("H", c("a1"), c("a2")), _key("I", given("postcode"), c("a1")), _key("J", c("a2"), given("house")), F.when(F.length(first) >= 2, _key("K", first, given("house"))),
        F.when((F.length(last) >= 2) & (F.length("concat") >= 1), _key("L", given("house"), F.substring("concat", 1, 1), last)),
    ]
    return own.select("id", "src", F.explode(F.array(*keys)).alias("k")).select("id", "src", "k.kind", "k.key").filter("key is not null").distinct()


#: Channels of retrieval by cosine: view, characters or words, sizes of grams, greatest share of targets that may hold a gram, and how many are kept.
CHANNELS = {
    "name_char": ("core", True, (3, 4), 0.03, 20), "address_char": ("addr_norm", True, (3, 4), 0.03, 40), "name_fold": ("name_fold", False, (1, 2), 0.05, 10),
    "address_fold": ("address_fold", False, (1, 2), 0.05, 10), "combo": ("combo", True, (3, 4), 0.03, 40), "combo_word": ("combo", False, (1, 2), 0.05, 60),
}


def channel_views(records: DataFrame) -> DataFrame:
    """Records with the views that channels read."""
    return records.withColumns({"name_fold": x.folded(F.col("core")), "address_fold": x.folded(F.col("addr_tok")), "combo": F.concat("core", F.lit(" "), "addr_norm")})


def _rules(spark, types: dict[str, tuple[int, int]]) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{k}', {w}, {cap}, {1 << BITS[k]})" for k, (w, cap) in types.items()) + " as rules(kind, weight, cap, bit)")


def capped(keys: DataFrame, types: dict[str, tuple[int, int]] = v.KEYS) -> DataFrame:
    """Target postings of keys that no more targets share than their type's cap."""
    targets = keys.filter("src > 1")
    sizes = targets.groupBy("kind", "key").agg(F.count_distinct("id").alias("n"))
    small = sizes.join(F.broadcast(_rules(keys.sparkSession, types)), "kind").filter("n <= cap")  # a dozen rules
    return targets.join(small, ["kind", "key"]).select("kind", "key", F.col("id").alias("t"), "weight", "bit")


def candidates(keys: DataFrame, types: dict[str, tuple[int, int]] = v.KEYS, top: int = 30) -> DataFrame:
    """s1, t, bscore, kmask: weights once a key type; the ``top`` best of each s1 (ties to the lesser t).

    Hits are sent once, to their s1; the weights of a pair are those of the types in its mask.
    """
    hits = keys.filter("src = 1").select(F.col("id").alias("s1"), "kind", "key").join(capped(keys, types), ["kind", "key"])
    score = sum((F.when(F.col("kmask").bitwiseAND(1 << BITS[k]) != 0, w).otherwise(0) for k, (w, _) in types.items()), F.lit(0)).cast("long")
    scored = hits.select("s1", "t", "bit").repartition("s1").groupBy("s1", "t").agg(F.bit_or("bit").alias("kmask")).select("s1", "t", score.alias("bscore"), "kmask")
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("bscore"), "t"))
    return scored.withColumn("rn", rank).filter(F.col("rn") <= top).drop("rn")


def grams(records: DataFrame, view: str, char: bool, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """id, src, country, g: distinct character grams of padded tokens, or words (and with sizes runs of words)."""
    own = x.char_grams(F.col(view), sizes or (3, 4)) if char else x.word_grams(F.col(view), sizes or (1,))
    return records.select("id", "src", "country", F.explode(own).alias("g"))


def _spread(postings: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """country, g, df, n over the target side: how many of a country's targets hold a gram; ``total`` has country and n where it is known."""
    targets = postings.filter("src > 1")
    total = targets.groupBy("country").agg(F.count_distinct("id").alias("n")) if total is None else total
    return targets.groupBy("country", "g").agg(F.count("*").alias("df")).join(F.broadcast(total), "country")  # a row a country


def idf(postings: DataFrame, max_df: float) -> DataFrame:
    """country, g, idf over the target side; grams in more than max_df of a country's targets are left out."""
    return _weights(_spread(postings), max_df).select("country", "g", "idf")


def _weights(spread: DataFrame, max_df: float) -> DataFrame:
    return spread.filter(F.col("df") <= F.col("n") * max_df).withColumn("idf", 1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).drop("df", "n")


def unit_postings(records: DataFrame, view: str, char: bool, max_df: float, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """id, src, country, g, w: the grams of each record weighted by IDF, to length 1."""
    postings = grams(records, view, char, sizes)
    weighted = postings.join(idf(postings, max_df), ["country", "g"])
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "src", "country", "g", (F.col("idf") / F.col("norm")).alias("w"))


def gram_vectors(records: DataFrame, view: str, char: bool, max_df: float, sizes: tuple[int, ...] | None = None, alone: bool = False) -> DataFrame:
    """id, src, country, v: each record's grams as numbers with their IDF; grams are numbered by a table that is written once.

    Where no two records share an id (``alone``) targets are counted without sending their ids.  Grams over ``max_df`` leave before the rest is shuffled.  Their list is broadcast: it has at most a record's grams / ``max_df`` rows a country.
    """
    postings = grams(records, view, char, sizes)
    own = records.filter("src > 1").filter(F.size(x.tokens(F.col(view)) if char else x.word_grams(F.col(view), sizes or (1,))) > 0)
    total = own.groupBy("country").agg(F.count("id").alias("n")) if alone else None
    spread = store.written(_spread(postings, total).withColumn("gid", F.monotonically_increasing_id()), "idf")
    often = F.broadcast(spread.filter(F.col("df") > F.col("n") * max_df).select("country", "g"))
    return postings.join(often, ["country", "g"], "left_anti").join(_weights(spread, max_df), ["country", "g"]).groupBy("id", "src", "country").agg(F.collect_list(F.struct("gid", "idf")).alias("v"))


def cosine_top(records: DataFrame, view: str, char: bool = False, max_df: float = 0.05, top: int = 5, reverse: bool = False, sizes: tuple[int, ...] | None = None, listed: bool = False) -> DataFrame:
    """q, t, cos, rn: each query's best by IDF cosine, within a country and a target source (see ``cosine``); ``listed`` a row a query and source, with lists t and cos.

    Records that share an id count as one of all their grams, whatever their countries.
    """
    return _best(_retrievable(records, view, char, max_df, sizes), top, reverse, listed)


def _retrievable(records: DataFrame, view: str, char: bool, max_df: float, sizes: tuple[int, ...] | None = None, again: bool = False) -> tuple[DataFrame, DataFrame | None, bool]:
    """Vectors of the records with an id, the lengths of ids with several rows (None if there are no such ids), and whether any of these is of several countries; ``again``: they are read several times."""
    ids = records.filter("id is not null").groupBy("id")
    n = ids.count().filter("count > 1").count()
    vectors = gram_vectors(records, view, char, max_df, sizes, not n).filter("id is not null")
    if not n:
        return store.written(vectors, "vectors") if again else vectors, None, False
    vectors = store.written(vectors, "vectors")
    repeated = ids.agg(F.count("*").alias("n"), F.coalesce(F.min("country") < F.max("country"), F.lit(False)).alias("wide")).filter("n > 1")
    squares = F.array_sort(F.flatten(F.collect_list(F.transform("v", lambda x: x["idf"] * x["idf"]))))
    lengths = vectors.join(repeated, "id").groupBy("id", "wide").agg(_length(squares).alias("norm"))
    lengths = store.written(lengths, "lengths")
    return vectors, lengths, bool(lengths.filter("wide").limit(1).count())


def _length(squares: Column) -> Column:
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def _best(retrievable: tuple[DataFrame, DataFrame | None, bool], top: int, reverse: bool, listed: bool = False) -> DataFrame:
    asked, held = ("src > 1", "src = 1") if reverse else ("src = 1", "src > 1")
    vectors, lengths, wide = retrievable
    if lengths is None:
        return cosine.top(vectors, asked, held, top, listed)
    return cosine.top_of_repeated(vectors.join(lengths, "id", "left"), asked, held, top, wide, listed)


def channels(records: DataFrame, names: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
    """q, t and a cosine a named channel, of all pairs that one of them finds."""
    own = channel_views(records)
    found = {}
    for name in names:
        view, char, sizes, max_df, top = CHANNELS[name]
        found[name] = cosine_top(own, view, char, max_df, top, sizes=sizes, listed=True)
    return channel_union(found)


def channel_union(channels: dict[str, DataFrame]) -> DataFrame:
    """q, t and a cosine column a channel (q and the lists t and cos), 0 where it did not find the pair.

    A query's list is sent as one row, so that what is sent does not grow by a row with every pair that is kept.
    """
    long = None
    for name, frame in channels.items():
        one = frame.select("q", F.lit(name).alias("channel"), F.arrays_zip("t", "cos").alias("found"))
        long = one if long is None else long.unionByName(one)
    long = long.repartition("q").select("q", "channel", F.explode("found").alias("pair")).select("q", "channel", "pair.t", "pair.cos")
    return long.groupBy("q", "t").agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("cos"))), F.lit(0.0)).alias(c) for c in channels])


def best_other(scored: DataFrame) -> DataFrame:
    """q, t, own, other, gap, rnk, n_close: each pair of ``scored`` against the best other s1 in its target's list there (q is the target).

    A target's rows stand together, best first, as ``cosine_top`` gives them in reverse; so they are read in passing, and not sent or sorted again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cosine.whole(batches):
            cos, own, place = b.column("cos").to_numpy(), *cosine.lists(b)
            at, end = np.flatnonzero(place == 0), np.bincount(own)
            second = np.where(end > 1, cos[np.minimum(at + 1, len(cos) - 1)], 0.0)
            other = np.where(place == 0, second[own], cos[at][own])
            new = np.append(True, cos[1:] != cos[:-1]) | (place == 0)
            rank = place[np.maximum.accumulate(np.where(new, np.arange(len(cos)), 0))] + 1
            close = np.bincount(own, cos >= cos[at][own] - 0.05).astype(np.int64) - 1
            columns = {"own": cos, "other": other, "gap": np.round(cos - other, 6) + 0.0, "rnk": rank.astype(np.int32), "n_close": close[own]}
            yield pa.RecordBatch.from_pydict({"q": b.column("q"), "t": b.column("t")} | {k: pa.array(a) for k, a in columns.items()})

    return scored.mapInArrow(run, "q string, t string, own double, other double, gap double, rnk int, n_close long")


def reverse_features(pairs: DataFrame, records: DataFrame, view: str, char: bool = False, max_df: float = 0.05, top: int = 6) -> DataFrame:
    """s1, t, own, other, gap, rnk, n_close of every pair, also where its s1 is not among its target's ``top`` best.

    own is the pair's cosine, taken directly; the others come from the target's list without the pair's s1: the best of
    them (0 if there is none), 1 + how many are above own, and how many are no more than 0.05 below it.
    A pair is sent twice, to its s1's grams and with them to its target's grams and list; not once a gram or entry of the list.
    """
    retrievable = _retrievable(records, view, char, max_df, again=True)
    vectors, lengths, _ = retrievable
    if lengths is not None:
        vectors = vectors.groupBy("id").agg(F.flatten(F.collect_list("v")).alias("v"))
    norm = _length(F.array_sort(F.transform("v.idf", lambda i: i * i)))
    entities = vectors.select(F.col("id").alias("s1"), F.col("v.gid").alias("g_s1"), norm.alias("n_s1"))
    targets = vectors.select(F.col("id").alias("t"), F.col("v.gid").alias("g_t"), F.col("v.idf").alias("idf"), norm.alias("n_t"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cosine.whole(batches):
            ends = pa.array(np.append(np.flatnonzero(cosine.lists(b)[1] == 0), b.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"t": b.column("q").take(ends[:-1])} | {k: pa.ListArray.from_arrays(ends, b.column(c)) for k, c in (("o", "t"), ("cos", "cos"))})

    hits = _best(retrievable, top, True).mapInArrow(gathered, "t string, o array<string>, cos array<double>")
    both = pairs.select("s1", "t").join(entities, "s1", "left").join(targets.join(hits, "t", "left"), "t", "left")
    both = both.select("s1", "t", "g_s1", "n_s1", "g_t", "idf", "n_t", F.when(F.col("s1").isNotNull(), F.col("cos")).alias("cos"), F.array_position("o", F.col("s1")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, flat = b.num_rows, {}, {}
            for c in ("g_s1", "g_t", "idf", "cos"):
                size[c] = pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False)
                flat[c] = b.column(c).flatten().to_numpy(zero_copy_only=False)
            mine, its, heard = (np.repeat(np.arange(n), size[c]) for c in ("g_s1", "g_t", "cos"))
            names, code = np.unique(np.concatenate([flat["g_s1"], flat["g_t"]]), return_inverse=True)
            key, times = np.unique(mine * len(names) + code[: len(mine)], return_counts=True)
            asked = its * len(names) + code[len(mine) :]
            at = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
            met = key[at] == asked if len(key) else np.zeros(len(asked), bool)
            dot = np.bincount(its[met], flat["idf"][met] ** 2 * times[at[met]], n)
            length = np.multiply(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("n_s1", "n_t")))
            own = np.round(np.divide(dot, length, out=np.zeros(n), where=dot > 0), 6)
            place = np.arange(len(heard)) - (np.cumsum(size["cos"]) - size["cos"])[heard] + 1
            left = place != pc.fill_null(b.column("at"), 0).to_numpy(zero_copy_only=False)[heard]
            heard, cos = heard[left], flat["cos"][left]
            who, first = np.unique(heard, return_index=True)
            other = np.zeros(n)
            other[who] = cos[first]
            above, close = (np.bincount(heard[x], minlength=n) for x in (cos > own[heard], cos >= own[heard] - 0.05))
            columns = {"own": own, "other": other, "gap": np.round(own - other, 6) + 0.0, "rnk": 1 + above, "n_close": close}
            yield pa.RecordBatch.from_pydict({"s1": b.column("s1"), "t": b.column("t")} | {k: pa.array(a) for k, a in columns.items()})

    return both.mapInArrow(run, "s1 string, t string, own double, other double, gap double, rnk long, n_close long")


def label_cosines(vectors: DataFrame, block: int = 1024) -> DataFrame:
    """a, b, cos: every two vectors of a label, a < b; cos is null where it is undefined (missing or zero vectors, different lengths).

    Blocks of at most ``block`` vectors are numbered and written once, and dealt to about the root of the shuffle partitions
    many groups.  Every two groups of a label meet in one place through an equi-join, and every two blocks there once, so
    memory is bounded by two blocks, and a block is sent once a group; every pair is a row, so the work grows with the
    square of a label.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2, math.ceil(math.sqrt(parts)))
    label = vectors.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict = {}
        for b in batches:
            held: dict[tuple, list] = {}
            kind = "<f4" if b.column("embedding").type.value_type == pa.float32() else "<f8"
            for i, k, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                dim = -1 if v is None or None in v else len(v)
                held.setdefault((k, dim), []).append((i, v))
            for (k, dim), own in held.items():
                for at in range(0, len(own), block):
                    ids, values = zip(*own[at : at + block], strict=True)
                    x = np.array(values, kind).tobytes() if dim > 0 else b""
                    turns[k] = turn = turns.get(k, TaskContext.get().partitionId()) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([k], b.column("label").type), pa.array([turn % groups], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([x], pa.binary())], names=["label", "own", "dim", "ids", "x"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                a, b = (np.frombuffer(r[k], "<i8") for k in ("ids_a", "ids_b"))
                i, j = np.triu_indices(len(a), 1, len(b)) if r["n_a"] == r["n_b"] else (slice(None), slice(None))
                pick = lambda m: m[i, j].ravel()  # noqa: B023, E731
                first, last = pick(np.minimum(a[:, None], b)), pick(np.maximum(a[:, None], b))
                keep = first != last  # rows that share an id are no pair
                undefined, cos = np.ones(len(first), bool), np.full(len(first), np.nan)
                if r["dim_a"] == r["dim_b"] > 0:
                    x, y = (np.frombuffer(r[f"x_{k}"], "<f4" if len(r[f"x_{k}"]) == 4 * len(m) * r["dim_a"] else "<f8").reshape(-1, r["dim_a"]).astype("<f8") for k, m in (("a", a), ("b", b)))
                    norms = (x**2).sum(1)[:, None] * (y**2).sum(1)
                    zero = norms == 0
                    norms[zero] = 1.0
                    full = x @ y.T
                    full /= np.sqrt(norms, out=norms)
                    np.round(full, 6, out=full)
                    full += 0.0  # no negative zero
                    undefined, cos = pick(zero), pick(full)
                if not keep.all():
                    first, last, cos, undefined = first[keep], last[keep], cos[keep], undefined[keep]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(last), pa.array(cos, pa.float64(), mask=undefined if undefined.any() else None)], names=["a", "b", "cos"])

    own = vectors.filter("vec_id is not null and label is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    packed = own.coalesce(max(1, parts // 4)).mapInArrow(pack, f"label {label}, own int, dim int, ids binary, x binary")
    packed = store.written(packed.withColumn("n", F.monotonically_increasing_id()), "blocks")

    def side(k: str, rest: Column) -> DataFrame:
        meet = F.struct(F.least("own", "rest").alias("low"), F.greatest("own", "rest").alias("high"))
        sent = packed.withColumn("rest", F.explode(rest)).withColumn("meet", meet)
        return sent.select("label", "meet", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "dim", "ids", "x")]).repartition(4 * parts, "label", "meet")

    left, right = side("a", F.sequence("own", F.lit(groups - 1))), side("b", F.sequence(F.lit(0), F.col("own")))
    met = left.join(right, ["label", "meet"]).filter((F.col("meet.low") < F.col("meet.high")) | (F.col("n_a") <= F.col("n_b")))
    return met.select("n_a", "n_b", "dim_a", "dim_b", "ids_a", "ids_b", "x_a", "x_b").mapInArrow(cells, "a long, b long, cos double")


def learn_transliteration(pairs: DataFrame, records: DataFrame, least: int = 3, jaccard: float = 0.2) -> DataFrame:
    """x, y, n: the token of source 1 that most often is missing where target token x is extra."""
    own = records.select("id", F.explode(F.array_distinct(x.tokens(F.col("core")))).alias("tok"))
    a = pairs.select("s1", "t").join(own.select(F.col("id").alias("s1"), "tok"), "s1")
    b = pairs.select("s1", "t").join(own.select(F.col("id").alias("t"), "tok"), "t")
    missing, extra = a.join(b, ["s1", "t", "tok"], "left_anti"), b.join(a, ["s1", "t", "tok"], "left_anti")
    together = extra.select("s1", "t", F.col("tok").alias("x")).join(missing.select("s1", "t", F.col("tok").alias("y")), ["s1", "t"]).groupBy("x", "y").agg(F.count("*").alias("n"))
    n_x, n_y = extra.groupBy(F.col("tok").alias("x")).agg(F.count("*").alias("nx")), missing.groupBy(F.col("tok").alias("y")).agg(F.count("*").alias("ny"))
    good = together.join(n_x, "x").join(n_y, "y").filter((F.col("n") >= least) & (F.col("n") >= jaccard * (F.col("nx") + F.col("ny") - F.col("n"))))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))
    return good.withColumn("rn", rank).filter("rn = 1").select("x", "y", "n")


def apply_dictionary(records: DataFrame, dictionary: DataFrame, view: str = "core") -> DataFrame:
    """id and its view with tokens replaced by the dictionary, in order."""
    own = records.select("id", F.posexplode(x.tokens(F.col(view))).alias("pos", "x")).join(dictionary.select("x", "y"), "x", "left")
    regrouped = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("y", "x").alias("w")))).alias("ws"))
    return records.select("id").join(regrouped, "id", "left").select("id", F.coalesce(F.array_join(F.transform("ws", lambda s: s["w"]), " "), F.lit("")).alias("mapped"))


def rivals(records: DataFrame, cap: int = 20) -> DataFrame:
    """t, n_rivals, overflow: how many s1 share the target's exact normalised name; lists over the cap are told, not counted."""
    names = records.filter(F.length("name_norm") >= 5)
    posts = names.filter("src = 1").groupBy("country", "name_norm").agg(F.count("*").alias("n"))
    joined = names.filter("src > 1").join(posts, ["country", "name_norm"], "left")
    return joined.select(F.col("id").alias("t"), F.when(F.col("n") <= cap, F.col("n")).alias("n_rivals"), F.coalesce(F.col("n") > cap, F.lit(False)).alias("overflow"))
