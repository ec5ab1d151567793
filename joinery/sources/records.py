"""Business records: schemas, TSV reading and writing, fixture records, ground truth, matching lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import store

RAW = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])

#: Records made from customers, in SQL of both engines: accents, record ids in brackets, misspelt legal words, digits for letters,
#: web names, units, nulls and empty addresses.  Source 2 also has decoys: a neighbouring house and another word.
RECORDS_SQL = """
select concat('S1-', cast(k as varchar(12))) entity_id, concat(nm, case when k % 17 = 0 then ' & Sons ( ID 12 ) Inc' else ' Inc' end) business_name, ad business_address, country, 1 src from base
union all select concat('S2-', cast(k as varchar(12))), upper(concat(case when k % 4 = 1 then replace(nm, 'e', '3') when k % 11 = 0 then replace(nm, 'e', 'é') else nm end, case when k % 7 = 1 then ' Companny LLC' when k % 7 = 2 then ' (id: 7) LLC' else ' LLC' end)), case when k % 9 = 4 then concat('Unit 7, ', ad) else ad end, country, 2 from base where k % 3 <> 0
union all select concat('S2-', cast(k + 10000000 as varchar(12))), concat('Alder ', seg, ' ', cast(k as varchar(12)), ' LLC'), replace(ad, cast(100 + k % 900 as varchar(12)), cast(101 + k % 900 as varchar(12))), country, 2 from base where k % 5 = 0
union all select concat('S3-', cast(k as varchar(12))), replace(concat(case when k % 13 = 0 then 'www.' else '' end, nm, ' Corp'), 'r', 'rr'), case when k % 7 = 0 then '' when k % 19 = 0 then null else replace(upper(ad), 'CEDAR', 'CÈDAR') end, country, 3 from base where k % 2 = 0
"""
BASE_SQL = """
select c_custkey k, concat('N', cast(c_nationkey % 3 as varchar(4))) country, c_mktsegment seg,
 concat(case c_custkey % 5 when 0 then 'Cedar' when 1 then 'Amber' when 2 then 'Zinc' when 3 then 'Birch' else 'Willow' end, ' ', c_mktsegment, ' ', cast(c_custkey as varchar(12))) nm,
 concat(cast(100 + c_custkey % 900 as varchar(12)), ' ', case c_custkey % 4 when 0 then 'Cedar Road' when 1 then 'Elm Street' when 2 then 'Park Avenue' else 'Hill Lane' end,
  ', City', cast(c_custkey % 37 as varchar(12)), ', ', cast(10000 + c_nationkey * 37 as varchar(12))) ad
from customer
"""


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    base = spark.sql(BASE_SQL.replace("from customer", "from {customer}"), customer=customer)
    return spark.sql(RECORDS_SQL.replace("from base", "from {base}"), base=base)


def fixture_truth(records: DataFrame) -> DataFrame:
    """s1, t of records of the same number."""
    key = F.split("entity_id", "-")[1]
    own = records.select("entity_id", "src", key.alias("k"))
    return own.filter("src = 1").select("k", F.col("entity_id").alias("s1")).join(own.filter("src > 1").select("k", F.col("entity_id").alias("t")), "k").select("s1", "t")


def read_tsv(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """Tab-separated, no quoting, all strings, empty cells as ''; the header must be the schema's."""
    header = spark.read.text(path).limit(1).first()
    if header is None or header[0].rstrip("\r").split("\t") != schema.fieldNames():
        raise ValueError(f"columns of {path}: {None if header is None else header[0]!r}")
    return spark.read.schema(schema).csv(path, sep="\t", quote="", escape="", header=True, nullValue="\u0000").na.fill("")


def load_sources(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Records of all sources with their number."""
    out = None
    for src, path in sorted(paths.items()):
        one = read_tsv(spark, path).withColumn("src", F.lit(src))
        out = one if out is None else out.unionByName(one)
    return out


def explode_truth(truth: DataFrame) -> DataFrame:
    own = truth.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("t"))
    return own.filter("t <> ''")


def row_ids(records: DataFrame) -> DataFrame:
    """A dense number by (src, entity_id), from counts of ranges: no single-task window.  The ranges are written once, so counts and ranks agree."""
    order = ["src", "entity_id"]
    ranged = records.repartitionByRange(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = store.written(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    before = placed.groupBy("_part").count().withColumn("_base", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(before.select("_part", F.coalesce("_base", F.lit(0)).alias("_base")), "_part").withColumn("row", F.col("_base") + rank - 1).drop("_part", "_base")


def matching_lists(entities: DataFrame, matches: DataFrame, by: str = "id") -> DataFrame:
    """One row an entity of source 1: ids in order of id, or of falling p and then id; '' if none."""
    if by == "id":
        lists = matches.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("ids"))
    else:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("t").alias("t"))))
        lists = matches.groupBy("s1").agg(F.array_join(F.transform(ranked, lambda x: x["t"]), ",").alias("ids"))
    joined = entities.join(lists, entities["entity_id"] == lists["s1"], "left")
    return joined.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def checked_lists(entities: DataFrame, matches: DataFrame, by: str = "id") -> DataFrame:
    """Matching lists of distinct pairs; fails if an entity has not exactly one row."""
    out = matching_lists(entities, matches.dropDuplicates(["s1", "t"]), by)
    rows = out.groupBy("source1_entity_id").agg(F.count("*").alias("_n"))
    ids = F.when(F.col("_n") == 1, F.col("matched_entity_ids")).otherwise(F.raise_error(F.lit("an entity has several rows")))
    return out.join(rows, "source1_entity_id").select("source1_entity_id", ids.alias("matched_entity_ids"))


def write_tsv(frame: DataFrame, path: str) -> None:
    frame.write.csv(path, sep="\t", quote="", escape="", header=True, emptyValue="")
