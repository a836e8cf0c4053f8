"""The test tables as specs, and relations derived from them for the small-input operators."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.sources.information_schema import InformationSchema
from inktally.spec import TableSpec

#: Key columns of each test table.
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": (),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}

#: Names of last-change columns in the test tables.
CANDIDATES = ("updated_at", "modified_at", "updatedon", "ts", "o_orderdate", "l_shipdate")

#: Catalog type names that the files cannot tell.
TYPES = {"events": {"props": "jsonb"}}


def table(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, TableSpec]:
    path = f"{folder}/{name}.parquet"
    frame = spark.read.parquet(path)
    spec = TableSpec.of(
        frame.schema, name, pk=KEYS[name], updated_at_candidates=CANDIDATES, types=TYPES.get(name)
    )
    return frame, spec


def tables(spark: SparkSession, folder: str, names=tuple(KEYS)) -> list[tuple[DataFrame, TableSpec]]:
    # Reading a file's schema is a small job; they need not wait for each other.
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda name: table(spark, folder, name), names))


def dealt(tables: list[tuple[DataFrame, TableSpec]]) -> list[tuple[DataFrame, TableSpec]]:
    """Tables of fewer splits than cores dealt out over the cores; larger ones are read as they are split."""

    def one(frame: DataFrame) -> DataFrame:
        cores = frame.sparkSession.sparkContext.defaultParallelism
        return frame if frame._jdf.rdd().getNumPartitions() >= cores else frame.repartition(cores)

    return [(one(frame), spec) for frame, spec in tables]


def local_scratch(spark: SparkSession) -> None:
    """A shared folder for sessions of one machine that have none; on a cluster the user names one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inktally-"))


def catalog_relations(spark: SparkSession, folder: str) -> InformationSchema:
    """Catalog relations with a table per user and a column per event."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    user = F.col("user_id")
    schema = F.concat(F.lit("s"), (user % 3).cast("string")).alias("table_schema")
    name = F.concat(F.when(user % 2 == 0, "Tab_").otherwise("tab_"), user.cast("string")).alias("table_name")
    users = events.select("user_id").distinct()
    plain = F.concat_ws("_", "event_type", (F.col("event_id") % 7).cast("string"))
    column = F.when(F.col("value") >= 10, F.upper(plain)).otherwise(plain).alias("column_name")
    place = F.col("event_id").cast("int").alias("ordinal_position")
    primary = F.concat(F.lit("pk_"), user.cast("string"))
    unique = F.concat(F.lit("uq_"), user.cast("string"))
    in_key = F.col("event_type").isin("purchase", "signup")
    kinds = F.create_map(
        *[
            F.lit(x)
            for x in (
                ("view", "CHARACTER VARYING")
                + ("signup", "jsonb")
                + ("error", "ARRAY")
                + ("click", "timestamp with time zone")
                + ("purchase", "uuid")
            )
        ]
    )
    return InformationSchema(
        users.select(schema, name, F.when(user % 5 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type")),
        events.select(
            schema,
            name,
            column,
            kinds[F.col("event_type")].alias("data_type"),
            F.when(F.col("value") > 5, "YES").otherwise("NO").alias("is_nullable"),
            F.when(F.col("event_type") == "click", F.col("props")).alias("column_default"),
            place,
        ),
        users.select(schema, name, primary.alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type")).unionByName(
            users.select(schema, name, unique.alias("constraint_name"), F.lit("UNIQUE").alias("constraint_type"))
        ),
        events.select(
            schema, name, F.when(in_key, primary).otherwise(unique).alias("constraint_name"), column, place
        ),
    )


def price_list(spark: SparkSession, folder: str) -> DataFrame:
    """A price list with an entry per part; model names repeat."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("ordinal"),
        F.col("p_brand").alias("provider"),
        F.concat_ws(" ", "p_type", "p_name").alias("model"),
        (F.col("p_retailprice") / 1000).alias("price_per_million"),
    )


def price_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Raw price entries with a JSON record per part, valid and not."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    model_key = (
        F.when(size % 6 == 0, F.concat(F.lit("text-embedding-"), key))
        .when(size % 6 == 1, F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("/"), key))
        .when(size % 6 == 2, F.concat(F.lit("/odd"), key))
        .when(size % 6 == 3, F.concat(F.lit("ada-"), key))
        .when(size % 6 == 4, F.concat(F.lit("embedding"), key))
        .otherwise(F.concat(F.lit("zzz"), key))
    )
    number = F.when(size % 2 == 0, F.concat(F.lit("0.0000000"), key)).otherwise(
        F.concat(size.cast("string"), F.lit("e-8"))
    )
    cost = (
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit(', "input_cost_per_token": "'), number, F.lit('"')))
        .when(F.col("p_type") == "SMALL", F.lit(""))
        .otherwise(F.concat(F.lit(', "input_cost_per_token": '), number))
    )
    provider = (
        F.when(size % 5 == 0, F.concat(F.lit(', "litellm_provider": "'), F.col("p_brand"), F.lit('"')))
        .when(size % 5 == 1, F.lit(', "litellm_provider": 5'))
        .otherwise(F.lit(""))
    )
    mode = F.when(size % 7 == 0, "chat").otherwise("embedding")
    entry = F.concat(F.lit('{"mode": "'), mode, F.lit('"'), cost, provider, F.lit("}"))
    return part.select(F.col("p_partkey").alias("ordinal"), model_key.alias("model_key"), entry.alias("entry"))


def price_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots by ship date and their entries, one per line item."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    entries = items.select(
        F.col("l_shipdate").alias("fetched_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("provider"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("model"),
        (F.col("l_extendedprice") / 1000).alias("price_per_million"),
    )
    return items.select(F.col("l_shipdate").alias("fetched_at")).distinct(), entries


def price_moments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A history with a list each 36 hours, one per ship date, its days spread over the years around the events."""
    snapshots, entries = price_history(spark, folder)
    start = "timestamp_ntz'1995-01-01 00:00:00'"
    # Days since 1995 become 36 hours since 2020, so that lists are in force for two thirds of the time.
    moved = F.expr(f"timestampadd(HOUR, 36 * timestampdiff(DAY, {start}, fetched_at), timestamp_ntz'2020-01-01 00:00:00')")
    return snapshots.withColumn("fetched_at", moved), entries.withColumn("fetched_at", moved)


def two_loads(spark: SparkSession, folder: str) -> list[tuple[TableSpec, DataFrame, DataFrame]]:
    """Two versions of tables with and without a key: rows that are missing from either, changed, and repeated."""
    orders, order_spec = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    old_orders = orders.where(key % 7 != 0)
    new_orders = orders.where(key % 11 != 0).withColumn(
        "o_orderstatus", F.when(key % 5 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus"))
    )
    items, item_spec = table(spark, folder, "lineitem")
    line = F.col("l_linenumber")
    old_items = items.where(line != 2)
    new_items = items.where(line != 3).unionByName(items.where(line == 4))
    return [(order_spec, old_orders, new_orders), (item_spec, old_items, new_items)]


def token_total(spark: SparkSession, folder: str) -> DataFrame:
    """A token total made from the events."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.agg(F.sum(F.col("event_id") % 7919).alias("total_tokens"))


def result_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A log of table results with a run per user and a table per event, and the runs."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    bad = F.col("event_type") == "error"
    log = events.select(
        F.col("user_id").alias("run_id"),
        F.lit("public").alias("schema"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("table"),
        F.when(bad, 0).otherwise(F.col("event_id") % 1000).cast("bigint").alias("row_count"),
        F.when(bad, 0).otherwise(F.col("event_id") % 7919).cast("bigint").alias("token_count"),
        F.when(bad, "error").otherwise("completed").alias("status"),
        F.when(bad, F.col("props")).alias("error_message"),
        F.col("ts").alias("completed_at"),
    )
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("ts").alias("started_at"), (F.count(F.lit(1)) + F.col("user_id") % 4).alias("total")
    )
    return log, runs
