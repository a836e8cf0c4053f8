"""Price lists: cleaning, choice of the current one, cost of a token total."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions.numbers import js_number_sql, to_fixed
from inktally.operators.ordering import carried

_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"
#: Beginnings of model names that tell their provider.
_OPENAI = ("text-embedding", "ada", "embedding")
_PRICE = ["ordinal", "provider", "model", "price_per_million"]


def infer_provider(model_key: Column, declared: Column) -> Column:
    """Provider of a model: as declared, else the key's prefix, else by well-known names."""
    prefix = F.when(F.instr(model_key, "/") > 1, F.substring_index(model_key, "/", 1))
    known = reduce(lambda a, b: a | b, [F.startswith(model_key, F.lit(p)) for p in _OPENAI])
    return F.coalesce(F.lower(declared), F.lower(prefix), F.when(known, "openai"), F.lit("other"))


def model_name(model_key: Column) -> Column:
    """The key after its first ``/``, unless it starts with that."""
    slash = F.instr(model_key, "/")
    return F.when(slash > 1, F.substr(model_key, slash + 1)).otherwise(model_key)


def price_per_million(cost_per_token: Column) -> Column:
    return cost_per_token * F.lit(1_000_000.0)


def parse_prices(entries: DataFrame) -> DataFrame:
    """Embedding models with a numeric price from ``ordinal``, ``model_key``, ``entry`` (JSON)."""
    record = entries.withColumn("_v", F.parse_json("entry"))
    cost = F.variant_get("_v", "$.input_cost_per_token", "variant")
    provider = F.variant_get("_v", "$.litellm_provider", "variant")
    mode = F.variant_get("_v", "$.mode", "variant")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    return (
        record.where(is_text(mode) & (F.try_variant_get("_v", "$.mode", "string") == "embedding"))
        .where(F.schema_of_variant(cost).rlike(_NUMERIC))
        .select(
            "ordinal",
            infer_provider(
                F.col("model_key"),
                F.when(is_text(provider), F.try_variant_get("_v", "$.litellm_provider", "string")),
            ).alias("provider"),
            model_name(F.col("model_key")).alias("model"),
            price_per_million(F.try_variant_get("_v", "$.input_cost_per_token", "double")).alias(
                "price_per_million"
            ),
        )
    )


def _day_before(as_of: datetime, kind: T.DataType) -> Column:
    """A literal 24 hours before ``as_of``, which no zone setting moves."""
    moment = as_of if as_of.tzinfo is None else as_of.astimezone(timezone.utc).replace(tzinfo=None)
    text = (moment - timedelta(hours=24)).isoformat(" ")
    return F.expr(f"timestamp_ntz'{text}'" if isinstance(kind, T.TimestampNTZType) else f"timestamp'{text}+00:00'")


def current_prices(
    snapshots: DataFrame,
    entries: DataFrame,
    as_of: datetime,
    fallback: DataFrame,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """The price list in force at ``as_of``.

    The newest snapshot younger than 24 hours, even if it has no entries; else
    the newly loaded list; else the fallback.  ``snapshots`` has ``fetched_at``;
    ``entries`` has it next to each price.  An ``as_of`` without a zone is UTC,
    as are timestamps without one, whatever the zone of driver and session.
    """
    newest = snapshots.where(F.col("fetched_at") > _day_before(as_of, snapshots.schema["fetched_at"].dataType)).agg(
        F.max("fetched_at").alias("fetched_at")
    )
    latest = newest.select("fetched_at").scalar()
    chosen = entries.where(F.col("fetched_at") == latest).select(*_PRICE)
    lists = [chosen]
    none_fresh = latest.isNull()
    if loaded is not None:
        lists.append(loaded.where(none_fresh).select(*_PRICE))
        none_fresh = none_fresh & ~loaded.exists()
    lists.append(fallback.where(none_fresh).select(*_PRICE))
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def prices_in_force(moments: DataFrame, snapshots: DataFrame, hours: int = 24) -> DataFrame:
    """``moments`` with ``fetched_at``: which price list was in force at each ``as_of``.

    The newest snapshot at that time, if it was younger than ``hours``; null
    means that there was none, so that the fallback was.  Moments and snapshots
    are put in one order of time, by ranges, and the last snapshot is carried on
    through them: no moment meets more than one.
    """
    kind = moments.schema["as_of"].dataType
    lists = snapshots.select(F.col("fetched_at").cast(kind).alias("_at"), F.col("fetched_at").cast(kind).alias("_list")).distinct()
    asked = moments.select(F.col("as_of").alias("_at"), F.lit(None).cast(kind).alias("_list"), F.struct(*moments.columns).alias("_given"))
    given = F.lit(None).cast(asked.schema["_given"].dataType).alias("_given")
    both = lists.select("_at", "_list", given).unionByName(asked)
    # Of equal times, the snapshot comes first.
    known = carried(both, [F.col("_at"), F.col("_given").isNotNull()], "_list", "in-force").where("_given is not null")
    fresh = F.col("_list") > F.col("_at") - F.expr(f"interval {int(hours)} hours")
    return known.select("_given.*", F.when(fresh, F.col("_list")).alias("fetched_at"))


#: Marks that lists of prices are told apart by before they are shuffled, and parts of a list that runs meet one by one.
MARKS, CELLS = 1 << 16, 16


def costs_in_force(runs: DataFrame, entries: DataFrame, fallback: DataFrame) -> DataFrame:
    """Cost of each run's ``total_tokens`` under each model of the price list that was in force, by ``fetched_at``.

    ``runs`` comes from :func:`prices_in_force`; a run without a list meets the
    fallback's models.  Of a list's entries with one model name the last counts.  Only
    entries of lists that may have been in force for a run are shuffled: marks of these
    lists, MARKS at most, are broadcast.  ``runs`` is read twice.  A list comes in CELLS
    parts by model, and each run is dealt to all of them, so that the runs of one list are
    not one task's.
    """
    kind = runs.schema["fetched_at"].dataType
    mark = lambda at: F.pmod(F.xxhash64(at), F.lit(MARKS)).cast("int").alias("__mark")
    at = F.col("fetched_at").cast(kind)
    known = entries.withColumn("__mark", mark(at)).join(F.broadcast(runs.select(mark("fetched_at")).distinct()), "__mark", "left_semi")
    listed = known.groupBy(at.alias("__list"), "model").agg(
        F.max_by("price_per_million", "ordinal").alias("price_per_million")
    )
    none = F.lit(None).cast(kind).alias("__list")
    every = listed.unionByName(price_map(fallback).select(none, "model", F.col("price_per_million").cast("double").alias("price_per_million")))
    parts, keys = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["__none", "__at", "__cell"]

    def dealt(frame: DataFrame, at: str, cell: Column) -> DataFrame:
        # A given number of partitions is kept: few rows here become very many.
        placed = frame.withColumns({"__none": F.col(at).isNull(), "__at": F.coalesce(at, F.lit("1970-01-01").cast(kind))})
        return placed.withColumn("__cell", cell).repartition(parts, *keys)

    lists = dealt(every, "__list", F.pmod(F.xxhash64("model"), F.lit(CELLS)).cast("int")).drop("__list")
    found = dealt(runs, "fetched_at", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).join(lists, keys).drop(*keys)
    return found.withColumn("cost", cost_of(F.col("total_tokens"), F.col("price_per_million")))


#: Models in a block that meets every run, and how many models may be broadcast in all.
BLOCK, BROADCAST = 1_000, 100_000


def costs_of_totals(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """``totals`` with ``model`` and ``cost``: a row for each of its rows and each model.

    The models are the query's own list: they come in blocks of about BLOCK,
    each row of ``totals`` is dealt to the blocks, and only the result holds a
    row per model.  Counts the models first.
    """
    models = price_map(prices)
    n = models.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("model"), F.lit(blocks)).cast("int").alias("_block")
    lists = models.groupBy(block).agg(F.collect_list(F.struct("model", "price_per_million")).alias("_models"))
    dealt = totals.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.join(F.broadcast(lists) if n <= BROADCAST else lists, "_block")
    found = found.select(*totals.columns, F.explode("_models").alias("_price"))
    cost = cost_of(F.col("total_tokens"), F.col("_price.price_per_million"))
    return found.select(*totals.columns, F.col("_price.model").alias("model"), cost.alias("cost"))


def price_map(prices: DataFrame) -> DataFrame:
    """One price per model name: that of its last entry."""
    return prices.groupBy("model").agg(
        F.max_by("price_per_million", "ordinal").alias("price_per_million")
    )


def cost_of(tokens: Column, price: Column) -> Column:
    """Cost of a token total, as a double that is never rounded."""
    return tokens.cast("double") / F.lit(1_000_000.0) * price


def cost_by_model(total: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of a token total under each model's price.

    ``total`` has one row with ``total_tokens``; it enters as a scalar, so the
    price list is neither broadcast nor shuffled against it.
    """
    tokens = F.coalesce(total.select("total_tokens").scalar(), F.lit(0))
    return (
        price_map(prices)
        .withColumn("total_tokens", tokens)
        .withColumn("cost", cost_of(F.col("total_tokens"), F.col("price_per_million")))
        .select("model", "price_per_million", "total_tokens", "cost")
    )


def provider_report(total: DataFrame, prices: DataFrame, digits: int = 6) -> DataFrame:
    """Every price entry with its label and cost.

    ``provider_ordinal`` and ``ordinal`` give the order of a printed report:
    providers as first seen, then their entries.  The label shows the entry's
    own price.  The cost follows the model name, so for a name listed twice it
    is that of the last entry; ``effective_price`` shows the price it used.
    """
    tokens = F.coalesce(total.select("total_tokens").scalar(), F.lit(0))
    last = F.max_by("price_per_million", "ordinal").over(Window.partitionBy("model"))
    first = F.min("ordinal").over(Window.partitionBy("provider"))
    shown = js_number_sql("price_per_million")
    label = F.expr(f"if(price_per_million = 0, 'free/local', concat('$', {shown}, '/1M tokens'))")
    return (
        prices.withColumn("effective_price", last)
        .withColumn("provider_ordinal", first)
        .withColumn("total_tokens", tokens)
        .withColumn("cost", F.coalesce(cost_of(F.col("total_tokens"), F.col("effective_price")), F.lit(0.0)))
        .select(
            "provider_ordinal",
            "ordinal",
            "provider",
            "model",
            "price_per_million",
            "effective_price",
            label.alias("price_label"),
            "cost",
        )
        .withColumn("cost_text", F.concat(F.lit("$"), to_fixed(F.col("cost"), digits)))
    )


def append_price_list(prices: DataFrame, fetched_at: datetime, snapshots_path: str, entries_path: str) -> None:
    """Adds a loaded list to the history that :func:`current_prices` reads.

    Its entries come first, so that whoever sees the snapshot sees them all.
    """
    moment = fetched_at if fetched_at.tzinfo is None else fetched_at.astimezone(timezone.utc).replace(tzinfo=None)
    at = F.expr(f"timestamp_ntz'{moment.isoformat(' ')}'")
    prices.select(at.alias("fetched_at"), *_PRICE).write.mode("append").parquet(entries_path)
    one = prices.sparkSession.range(1).select(at.alias("fetched_at"))
    one.write.mode("append").parquet(snapshots_path)
