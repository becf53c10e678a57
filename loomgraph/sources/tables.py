"""Driver tables, and the entity, edge, passage and vector tables that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANT = "t0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_documents(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with text, and the quarantined rest (blank or NULL text, or NUL in it)."""
    good = F.coalesce((F.trim(F.col(text)) != "") & (F.instr(F.col(text), F.lit("\0")) == 0), F.lit(False))
    return docs.filter(good), docs.filter(~good)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, id, name, entity_type."""

    def part(name: str, prefix: str, key: str, label: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(TENANT).alias("tenant_id"), F.concat(F.lit(prefix), F.col(key)).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("entity_type"))

    kinds = (("customer", "c", "c_custkey", "c_name", "customer"), ("supplier", "s", "s_suppkey", "s_name", "supplier"), ("part", "p", "p_partkey", "p_name", "part"), ("nation", "n", "n_nationkey", "n_name", "nation"), ("region", "r", "r_regionkey", "r_name", "region"))
    first, *rest = [part(*k) for k in kinds]
    for x in rest:
        first = first.unionByName(x)
    return first


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, dst, type: customers and suppliers in nations, nations in regions, what suppliers supply."""

    def of(df: DataFrame, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(kind).alias("type"))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # not fewer: a task holds its pairs in a hash table, many times their size in the shuffle
    supplies = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition(tasks, "l_suppkey", "l_partkey").distinct()
    found = of(table(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey", "located_in")
    found = found.unionByName(of(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "located_in"))
    found = found.unionByName(of(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "part_of"))
    found = found.unionByName(of(supplies, "s", "l_suppkey", "p", "l_partkey", "supplies"))
    return found.select(F.md5(F.concat_ws("|", "src", "dst", "type")).alias("id"), "src", "dst", "type")


ENTITY_SQL = """
v_entity AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, 'customer' AS entity_type FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region)"""
EDGE_SQL = """
v_edge AS (SELECT md5(src || '|' || dst || '|' || type) AS id, * FROM (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'located_in' AS type FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'supplies' FROM lineitem))"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: the distinct part names, each with its smallest part."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias, canonical: every part that shares its name with a smaller one, pointing at the next smaller: long chains."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_name", "p_brand").alias("key"))
    from pyspark.sql import Window

    before = F.lag("p_partkey").over(Window.partitionBy("key").orderBy("p_partkey"))
    return names.select(F.col("p_partkey").alias("alias"), before.alias("canonical")).filter("canonical is not null")
