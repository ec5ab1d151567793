"""Splits, samples, weights, guards and boosted trees for scored pairs.

Splits and samples follow from hashes of ids, so they are the same on every run and cluster, and nested: a larger
sample holds the smaller.  Models are Spark ML's gradient-boosted trees (no monotone constraints, no leaf-wise
growth; early stopping by a marked part of the rows).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..sources import store


def folds(entities: DataFrame, records: DataFrame, k: int = 5, salt: str = "fold:") -> DataFrame:
    """s1, fold, inner: stable folds, in which exact duplicates (country, core, address) follow the least of them; inner marks a tenth for early stopping."""
    views = records.filter("src = 1").select(F.col("id").alias("s1"), F.concat_ws("|", F.coalesce("country", F.lit("")), "core", "addr_norm").alias("_same"), "core")
    own = entities.select("s1").join(views, "s1").withColumn("_own", x.stable_mod(F.col("s1"), salt, k))
    first = F.first("_own").over(Window.partitionBy("_same").orderBy("s1"))
    return own.select("s1", F.when(F.col("core") != "", first).otherwise(F.col("_own")).alias("fold"), (x.stable_mod(F.col("s1"), f"inner-{salt}", 10) == 0).alias("inner"))


def split(entities: DataFrame, salt: str = "split:", audit: int = 10, validation: int = 10) -> DataFrame:
    """s1, part: 'audit', 'validation' (so many percent each) or 'fit', by a stable hash."""
    h = x.stable_mod(F.col("s1"), salt, 100)
    return entities.select("s1", F.when(h < audit, "audit").when(h < audit + validation, "validation").otherwise("fit").alias("part"))


def permuted(entities: DataFrame, salt: str = "order:") -> DataFrame:
    """s1, place: a seeded permutation's key; the n least places are a sample, and those of a larger n hold them."""
    return entities.select("s1", F.sha2(F.concat(F.lit(salt), F.col("s1")), 256).alias("place"))


def sample(entities: DataFrame, n: int, salt: str = "order:") -> DataFrame:
    """n entities: a limit that is the operator's meaning; it plans as a top-n, not as a sort of all."""
    return permuted(entities, salt).orderBy("place", "s1").limit(n).select("s1")


def modulus_sample(entities: DataFrame, k: int, salt: str = "sample:") -> DataFrame:
    return entities.filter(x.stable_mod(F.col("s1"), salt, k) == 0)


def examples(frame: DataFrame, stratum: Column, key: str, n: int) -> DataFrame:
    """Round-robin over strata: the first of each, then the second of each, and so on, n rows in all."""
    own = frame.withColumn("_stratum", stratum)
    ranked = own.withColumn("_depth", F.row_number().over(Window.partitionBy("_stratum").orderBy(key)))
    return ranked.filter(F.col("_depth") <= n).orderBy("_depth", "_stratum").limit(n).drop("_depth").withColumnRenamed("_stratum", "stratum")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1", "t", F.lit(1.0).alias("y")), ["s1", "t"], "left").fillna(0.0, ["y"])


def without_leaks(pairs: DataFrame, truth: DataFrame, held_out: DataFrame) -> DataFrame:
    """Pairs of other entities than the held-out ones, without targets that those own."""
    owned = truth.join(held_out.select("s1"), "s1", "left_semi").select("t").distinct()
    return pairs.join(held_out.select("s1"), "s1", "left_anti").join(owned, "t", "left_anti")


def shared_targets(truth: DataFrame, parts: DataFrame) -> DataFrame:
    """t, n: true targets that entities of several parts own; a split is sound if there are none."""
    return truth.join(parts, "s1").groupBy("t").agg(F.count_distinct("part").alias("n")).filter("n > 1")


def weighted(pairs: DataFrame, keep: float, hard: int = 10, by: str = "p", salt: str = "easy:") -> DataFrame:
    """All true pairs and hard negatives (among the ``hard`` best of their s1), and a stable share of easy ones with the inverse weight."""
    ranked = pairs.withColumn("_rank", F.rank().over(Window.partitionBy("s1").orderBy(F.desc(by))))
    easy = (F.col("y") == 0) & (F.col("_rank") > hard)
    u = x.stable_mod(F.concat("s1", F.lit("|"), "t"), salt, 1_000_000) / 1_000_000
    return ranked.filter(~easy | (u < keep)).withColumn("w", F.when(easy, 1 / keep).otherwise(1.0)).drop("_rank")


def _assembled(frame: DataFrame, features: list[str]) -> DataFrame:
    own = frame.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_f_{c}") for c in features])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(own).drop(*[f"_f_{c}" for c in features])


def train(frame: DataFrame, features: list[str], rounds: int = 20, depth: int = 5, seed: int = 42, stop: str | None = None) -> GBTClassificationModel:
    """Boosted trees on y with weights w; ``stop`` names a boolean column that marks rows for early stopping."""
    own = _assembled(frame, features)
    gbt = GBTClassifier(labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.9, featureSubsetStrategy="0.9", stepSize=0.2)
    return (gbt.setValidationIndicatorCol(stop) if stop else gbt).fit(own)


def score(frame: DataFrame, model: GBTClassificationModel, features: list[str], out: str = "p") -> DataFrame:
    got = model.transform(_assembled(frame, features)).withColumn(out, F.round(vector_to_array("probability")[1], 6))
    return got.drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(frame: DataFrame, features: list[str], k: int, **settings) -> DataFrame:
    """Each fold scored by a model of the others (columns fold, inner, y, w): models are one after the other, rows distributed."""
    out = None
    for f in range(k):
        model = train(frame.filter(F.col("fold") != f), features, stop="inner", **settings)
        one = score(frame.filter(F.col("fold") == f), model, features)
        out = one if out is None else out.unionByName(one)
    return out


def ensemble(scores: list[DataFrame]) -> DataFrame:
    """s1, t, p: the mean of aligned scores; a pair that one of them lacks has a null mean, so misalignment shows."""
    long = None
    for one in scores:
        long = one.select("s1", "t", "p") if long is None else long.unionByName(one.select("s1", "t", "p"))
    return long.groupBy("s1", "t").agg(F.when(F.count("*") == len(scores), F.round(F.avg("p"), 7)).alias("p"))


def save(spark: SparkSession, model: GBTClassificationModel, features: list[str], path: str) -> str:
    """Write the model with its features and a checksum of its trees, which is returned."""
    model.write().overwrite().save(f"{path}/model")
    pin = hashlib.sha256(model.toDebugString.split("\n", 1)[1].encode()).hexdigest()
    store.Store(spark, path).put("pin.json", json.dumps({"features": features, "sha256": pin}).encode())
    return pin


def load(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, list[str]]:
    """The model and its features; fails if the trees are not those that were saved."""
    model = GBTClassificationModel.load(f"{path}/model")
    pin = json.loads(store.Store(spark, path).get("pin.json"))
    if hashlib.sha256(model.toDebugString.split("\n", 1)[1].encode()).hexdigest() != pin["sha256"]:
        raise ValueError(f"the model at {path} is not the one that was saved")
    return model, pin["features"]
