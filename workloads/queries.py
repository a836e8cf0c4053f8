"""One query per operator over the test tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.functions.json_text import with_canonical_json
from inktally.operators import catalog, changes, prices, profile, progress, slices
from inktally.operators import tokens as token_jobs
from inktally.operators.dictionary import PieceDictionary
from inktally.operators.documents import RowText, documents, for_each_table, narrow_page_texts, page_texts, union_all
from inktally.operators.estimates import table_report, total_rows, total_tokens
from inktally.operators.statistics import snapshots_from_statistics
from inktally.plans.chunks import ChunkLog, Chunking, KeyRanges, count_chunks
from inktally.plans.estimate import (
    TableSource,
    all_piece_counts,
    estimate_tables,
    estimate_with_dictionary,
    repeating_tables,
    sources_of,
    table_results,
)
from inktally.sources import information_schema
from inktally.sources.price_files import fallback_prices, read_price_file
from inktally.sources.scratch import scratch_folder
from inktally.sources.tables import read_table
from inktally.spec import EstimateConfig, TableSpec
from inktally.streaming import progress as following
from workloads.tables import (
    KEYS,
    catalog_relations,
    dealt,
    local_scratch,
    price_entries,
    price_history,
    price_list,
    price_moments,
    result_log,
    table,
    tables,
    token_total,
    two_loads,
)

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

SCHEMA = "s1"
BLOCKED = ("TAB_7", "tab_4", "*")
UPDATED = ("missing", "SIGNUP_3", "view_1", "click_0")
AS_OF = datetime(2000, 6, 1, 12)
LATE = datetime(2030, 1, 1)
THRESHOLD, CHUNK = 1_000, 700


def query(run: Query) -> Query:
    @wraps(run)
    def with_scratch(spark: SparkSession, folder: str) -> DataFrame:
        local_scratch(spark)
        return run(spark, folder)

    _QUERIES[run.__name__] = with_scratch
    return run


def tokenizer() -> token_jobs.Tokenizer:
    """The installed public vocabulary."""
    import public_tokenizers

    return token_jobs.Tokenizer.from_rank_file(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def pairs_tokenizer() -> token_jobs.Tokenizer:
    """The single bytes and three pairs that share no byte: a text has as many tokens as bytes less its pairs."""
    import public_tokenizers

    ranks = {bytes([b]): b for b in range(256)} | {pair: 256 + i for i, pair in enumerate((b"he", b"an", b"ou"))}
    return token_jobs.Tokenizer(public_tokenizers.PATTERN, ranks)


# Catalog


@query
def list_tables(spark, folder):
    return catalog.list_tables(catalog_relations(spark, folder).tables, SCHEMA)


@query
def select_tables(spark, folder):
    found = catalog.list_tables(catalog_relations(spark, folder).tables, SCHEMA)
    return catalog.select_tables(found, ["*"], BLOCKED)


@query
def table_columns(spark, folder):
    return catalog.table_columns(catalog_relations(spark, folder).columns)


@query
def primary_keys(spark, folder):
    relations = catalog_relations(spark, folder)
    return catalog.primary_keys(relations.table_constraints, relations.key_column_usage)


@query
def annotate_pk(spark, folder):
    relations = catalog_relations(spark, folder)
    keys = catalog.primary_keys(relations.table_constraints, relations.key_column_usage)
    return catalog.annotate_pk(catalog.table_columns(relations.columns), keys)


@query
def resolve_updated_at(spark, folder):
    columns = catalog.table_columns(catalog_relations(spark, folder).columns)
    return catalog.resolve_updated_at(columns, UPDATED)


@query
def table_catalog(spark, folder):
    return catalog.table_catalog(catalog_relations(spark, folder), SCHEMA, ["*"], BLOCKED, UPDATED)


@query
def content_columns(spark, folder):
    columns = catalog.table_columns(catalog_relations(spark, folder).columns)
    return catalog.content_columns(columns, "auto", ["VIEW_1"])


# Profiles, slices, chunks


@query
def read_table_orders(spark, folder):
    _, spec = table(spark, folder, "orders")
    return read_table(spark, spec, f"{folder}/orders.parquet")


@query
def table_row_count(spark, folder):
    return profile.row_counts(tables(spark, folder))


@query
def table_max_updated_at(spark, folder):
    return union_all(
        [
            frame.agg(profile.max_updated_at(frame, spec).alias("max_updated_at")).select(
                F.lit(spec.table).alias("table"), "max_updated_at"
            )
            for frame, spec in tables(spark, folder)
        ]
    )


@query
def table_max_pk(spark, folder):
    return union_all(
        [
            frame.agg(profile.max_pk(spec).alias("max_pk")).select(F.lit(spec.table).alias("table"), "max_pk")
            for frame, spec in tables(spark, folder)
        ]
    )


@query
def table_snapshot(spark, folder):
    return profile.table_snapshots(tables(spark, folder))


@query
def table_snapshot_statistics(spark, folder):
    """All tables and one of orders by day, from the statistics in their files where these say enough."""
    local_scratch(spark)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    dated = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("updated_at"))
    ordered = dated.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    path = _new_path(spark, "orders-by-day")
    ordered.write.parquet(path)
    named = [(f"{folder}/{name}.parquet", table(spark, folder, name)[1]) for name in KEYS]
    return snapshots_from_statistics(spark, [*named, (path, TableSpec.of(ordered.schema, "orders_by_day", pk=("o_orderkey",)))])


@query
def large_tables(spark, folder):
    return profile.large_tables(profile.row_counts(tables(spark, folder)), THRESHOLD)


@query
def chunk_plan(spark, folder):
    return slices.chunk_plan(profile.row_counts(tables(spark, folder)), THRESHOLD, CHUNK)


@query
def ordered_slice(spark, folder):
    return slices.ordered_slice(*table(spark, folder, "orders"), offset=1000, limit=300)


@query
def deep_slice(spark, folder):
    return slices.ordered_slice(*table(spark, folder, "events"), offset=900, limit=90)


@query
def slice_lineitem(spark, folder):
    """A slice of a table without a key, in the order of all its columns."""
    return slices.ordered_slice(*table(spark, folder, "lineitem"), offset=3000, limit=1000)


@query
def bounded_scan(spark, folder):
    return slices.bounded_scan(*table(spark, folder, "events"), offset=500)


@query
def chunk_estimates(spark, folder):
    frame, spec = table(spark, folder, "orders")
    texts = RowText(frame, spec).texts
    return slices.chunk_estimates(texts, spec, F.length("page_content"), 1000, costly=False)


def _chunk_tokens(spark, folder, used):
    frame, spec = table(spark, folder, "documents")
    return slices.chunk_estimates(used.with_count(RowText(frame, spec).texts), spec, F.col("token_count"), 100)


@query
def chunk_tokens(spark, folder):
    return _chunk_tokens(spark, folder, tokenizer())


@query
def chunk_tokens_pairs(spark, folder):
    return _chunk_tokens(spark, folder, pairs_tokenizer())


#: Tables of the resumed run: their chunk rows.
RESUMED = {"orders": 1000, "documents": 100, "lineitem": 5000}


def _new_path(spark, label):
    return f"{scratch_folder(spark)}/{label}-{os.urandom(8).hex()}"


def _resumed(spark, folder):
    """Chunks of three tables, counted in two goes: the first stops after two ranges of each table, the second goes on."""
    path, used, plans = _new_path(spark, "resumed"), pairs_tokenizer(), []
    log = ChunkLog(f"{path}/log")
    for name, rows in RESUMED.items():
        frame, spec = table(spark, folder, name)
        counted = used.with_count(RowText(frame, spec).texts)
        ranges = KeyRanges.write(frame, spec, f"{path}/{name}", rows, 4)
        for most in (2, None):
            ranges = KeyRanges.read(spark, spec, f"{path}/{name}", rows)
            count_chunks(counted, ranges, F.col("token_count"), log, 1, most)
        plans.append(ranges.plan())
    return log.read(spark, 1), union_all(plans)


@query
def resumed_chunks(spark, folder):
    """Each chunk of a run that stopped and went on, and how often it is in the log."""
    log, _ = _resumed(spark, folder)
    chunk = ["schema", "table", "chunk_id", "chunk_index", "row_count", "token_count"]
    return log.groupBy(*chunk).agg(F.count(F.lit(1)).alias("arrived"))


@query
def resumed_estimates(spark, folder):
    return slices.merge_chunks(*_resumed(spark, folder))


@query
def range_slices(spark, folder):
    """Slices of two tables read through their key ranges, one across the border of ranges."""
    found = []
    for name, offset, limit in (("orders", 700, 900), ("lineitem", 3000, 1000)):
        frame, spec = table(spark, folder, name)
        ranges = KeyRanges.write(frame, spec, _new_path(spark, "ranges"), 500, 8)
        key = [c for c in ("o_orderkey", "l_orderkey", "l_linenumber") if c in frame.columns]
        found.append(ranges.slice(frame, offset, limit).select(F.lit(name).alias("table"), F.col(key[0]).alias("first"), F.col(key[-1]).cast("bigint").alias("last")))
    return union_all(found)


def _arrived(spark, folder):
    """Chunk results of two tables, with the first chunk of the second one missing."""
    parts = []
    for name, measure in (("lineitem", "l_linenumber"), ("customer", "c_nationkey")):
        frame, spec = table(spark, folder, name)
        parts.append(slices.chunk_estimates(frame, spec, F.col(measure), CHUNK, costly=False))
    late = F.col("chunk_id") == "public.customer#0"
    plan = slices.chunk_plan(profile.row_counts(tables(spark, folder)), 0, CHUNK)
    return union_all(parts).where(~late), plan


@query
def merge_chunks(spark, folder):
    return slices.merge_chunks(*_arrived(spark, folder))


@query
def chunk_progress(spark, folder):
    return slices.chunk_progress(*_arrived(spark, folder))


# Documents


def _content(spark, folder, name, config=None, frame=None):
    read, spec = table(spark, folder, name)
    frame = read if frame is None else frame
    return RowText(frame, spec, config).texts.select(*spec.pk, "page_content")


@query
def page_content_customer(spark, folder):
    return _content(spark, folder, "customer")


@query
def page_content_all_columns(spark, folder):
    return _content(spark, folder, "orders", EstimateConfig(mode="all"))


@query
def page_content_excluded(spark, folder):
    return _content(spark, folder, "orders", EstimateConfig(excluded=("O_ORDERSTATUS",)))


@query
def page_content_nulls(spark, folder):
    frame, _ = table(spark, folder, "orders")
    frame = frame.withColumns(
        {
            "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
            "o_orderpriority": F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(
                F.nullif("o_orderpriority", F.lit("5-LOW"))
            ),
        }
    )
    return _content(spark, folder, "orders", None, frame)


@query
def page_content_narrow(spark, folder):
    """The texts of all tables, each in two scans: content columns, then rows without lines."""
    return for_each_table(narrow_page_texts, tables(spark, folder))


@query
def fallback_content_labels(spark, folder):
    return _content(spark, folder, "labels")


@query
def fallback_content_embeddings(spark, folder):
    return _content(spark, folder, "embeddings")


def _row_json(spark, folder, name):
    frame, spec = table(spark, folder, name)
    row = RowText(frame, spec)
    return row.full.select(*spec.pk, row.row_json.alias("row_json"))


@query
def canonical_json_orders(spark, folder):
    return _row_json(spark, folder, "orders")


@query
def canonical_json_lineitem(spark, folder):
    return _row_json(spark, folder, "lineitem")


@query
def canonical_json_numbers(spark, folder):
    """JSON documents made of the numbers of parts, written as they are and in ways of their own."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    price, key = F.col("p_retailprice").cast("string"), F.col("p_partkey").cast("string")
    tail = F.when(F.col("p_partkey") % 3 == 0, "00").when(F.col("p_partkey") % 3 == 1, "e0").otherwise("")
    made = F.concat(
        F.lit('{"b": '), price, tail, F.lit(', "a": ['), key, F.lit('.0, -0, 1E2, "v1.2"], "c": {"z": '), price,
        F.lit(', "y": 12345678901234567}}'),
    )
    rows = part.select("p_partkey", made.alias("document"))
    return with_canonical_json(rows, F.col("document"), "row_json").select("p_partkey", "row_json")


@query
def canonical_json_nested(spark, folder):
    """Events with variants inside arrays, maps and structs, whose numbers are written in ways of their own."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    value = F.col("value").cast("string")
    loose = F.parse_json(F.concat(F.lit('{"y": '), value, F.lit('00, "x": ["1.50", '), value, F.lit("e0, 2.5E-7, 1E22]}")))
    large = F.parse_json(F.concat(F.lit("1234567890123"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("0")))
    made = events.select(
        "event_id",
        F.array(F.parse_json("props"), loose, F.lit(None).cast("variant")).alias("list"),
        F.create_map(F.lit("10"), loose, F.lit("9"), large).alias("map"),
        F.struct(F.struct(large.alias("z"), "value").alias("b"), F.array(F.array(loose)).alias("a")).alias("tree"),
    )
    row = RowText(made, TableSpec.of(made.schema, "events", pk=("event_id",)))
    return row.full.select("event_id", row.row_json.alias("row_json"))


@query
def canonical_json_events(spark, folder):
    return _row_json(spark, folder, "events")


@query
def extract_pk(spark, folder):
    frame, spec = table(spark, folder, "conversations")
    row = RowText(frame, spec)
    return row.full.select(*spec.pk, row.pk_json.alias("pk"))


def _hashes(name):
    def run(spark, folder):
        frame, spec = table(spark, folder, name)
        ((frame, spec),) = dealt([(frame, spec)])
        return documents(frame, spec).select("doc_id", "pk_hash", "row_hash", "has_pk")

    return run


_QUERIES["hashes_nation"] = _hashes("nation")
_QUERIES["hashes_conversations"] = _hashes("conversations")
_QUERIES["hashes_lineitem"] = _hashes("lineitem")


@query
def updated_at_value(spark, folder):
    frame, spec = table(spark, folder, "events")
    row = RowText(frame, spec)
    return row.rows.select("event_id", row.updated_at.alias("updated_at"))


@query
def all_documents(spark, folder):
    return for_each_table(documents, dealt(tables(spark, folder)))


# Tokens and estimates


def _doc_tokens(spark, folder, used):
    ((frame, spec),) = dealt([table(spark, folder, "documents")])
    return token_jobs.doc_tokens(RowText(frame, spec).texts, used, ("doc_id",))


@query
def doc_tokens(spark, folder):
    return _doc_tokens(spark, folder, tokenizer())


@query
def doc_tokens_pairs(spark, folder):
    return _doc_tokens(spark, folder, pairs_tokenizer())


def _all_pieces(spark, folder, used):
    read = tables(spark, folder)
    return all_piece_counts(dealt(read), used, repeating=repeating_tables(read))


@query
def piece_counts(spark, folder):
    return _all_pieces(spark, folder, tokenizer())


@query
def piece_tokens(spark, folder):
    used = tokenizer()
    return token_jobs.piece_tokens(_all_pieces(spark, folder, used), used)


@query
def piece_tokens_pairs(spark, folder):
    used = pairs_tokenizer()
    return token_jobs.piece_tokens(_all_pieces(spark, folder, used), used)


@query
def pieces_in_vocabulary(spark, folder):
    """How many distinct pieces the rank table holds, and how often they occur, per table."""
    used = tokenizer()
    pieces = _all_pieces(spark, folder, used).withColumn("token", F.encode("piece", "utf-8"))
    return (
        pieces.join(used.rank_table(spark), "token")
        .groupBy("schema", "table")
        .agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_count").alias("occurrences"))
    )


@query
def table_estimates(spark, folder):
    return estimate_tables(tables(spark, folder), tokenizer())


@query
def table_estimates_pairs(spark, folder):
    return estimate_tables(tables(spark, folder), pairs_tokenizer())


@query
def dictionary_estimates(spark, folder):
    """Estimates by a dictionary of pieces that the same tables taught before: nothing is left to learn."""
    dictionary = PieceDictionary(spark, _new_path(spark, "pieces"), pairs_tokenizer(), 8)
    read = dealt(tables(spark, folder))
    estimate_with_dictionary(read, dictionary)
    found, learned = estimate_with_dictionary(read, dictionary)
    return found.withColumn("learned", F.lit(learned).cast("bigint"))


@query
def total_of_tokens_pairs(spark, folder):
    return total_tokens(table_estimates_pairs(spark, folder))


@query
def table_report_pairs(spark, folder):
    return table_report(table_estimates_pairs(spark, folder))


@query
def embedding_cost_pairs(spark, folder):
    total = total_tokens(table_estimates_pairs(spark, folder))
    return prices.provider_report(total, fallback_prices(spark)).select("provider", "model", "cost", "cost_text")


@query
def total_of_tokens(spark, folder):
    return total_tokens(table_estimates(spark, folder))


@query
def total_of_rows(spark, folder):
    return total_rows(table_estimates(spark, folder))


@query
def table_report_tokens(spark, folder):
    return table_report(table_estimates(spark, folder))


@query
def table_report_characters(spark, folder):
    """The report over text lengths, which SQL can check."""
    texts = for_each_table(page_texts, tables(spark, folder))
    sums = texts.groupBy("schema", "table").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.length("page_content")).alias("token_count")
    )
    return table_report(sums)


def _results(spark, folder, used, names):
    sources = [
        TableSource("public", n, lambda n=n: table(spark, folder, n) if n in KEYS else _absent(spark, folder, n))
        for n in names
    ]
    return table_results(spark, sources, used)


@query
def table_results_one_missing(spark, folder):
    found = _results(spark, folder, tokenizer(), ("region", "documents", "absent"))
    return found.select("schema", "table", "row_count", "status")


@query
def table_results_pairs(spark, folder):
    """The results of all tables and of one that is missing."""
    found = _results(spark, folder, pairs_tokenizer(), (*KEYS, "absent"))
    return found.select(
        "schema", "table", "row_count", "token_count", "status", F.col("error_message").isNotNull().alias("has_error")
    )


@query
def table_results_by_chunks(spark, folder):
    """The results of all tables, large ones by chunks whose log a second run finds complete."""
    chunking = Chunking(_new_path(spark, "chunked"), 1, THRESHOLD, CHUNK, 3)
    sources = [TableSource("public", n, lambda n=n: table(spark, folder, n)) for n in ("nation", "customer", "events", "pages")]
    for _ in range(2):
        found = table_results(spark, sources, pairs_tokenizer(), EstimateConfig(time_limit=3600), chunking=chunking)
    return found.select("schema", "table", "row_count", "token_count", "status")


@query
def estimate_from_catalog(spark, folder):
    """From the catalog of the tables to their results."""
    specs = {spec.table: spec for _, spec in tables(spark, folder)}
    relations = information_schema.of_specs(spark, specs.values())

    def read(spec):
        return read_table(spark, spec, f"{folder}/{spec.table}.parquet")

    found = table_results(spark, sources_of(relations, "public", read, block=("labels",)), pairs_tokenizer())
    return found.select("schema", "table", "row_count", "token_count", "status")


def _absent(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet"), None


@query
def embedding_cost(spark, folder):
    """The whole estimate: all tables, all models of the built-in list."""
    total = total_tokens(table_estimates(spark, folder))
    return prices.provider_report(total, fallback_prices(spark)).select(
        "provider", "model", "price_per_million", "price_label", "cost", "cost_text"
    )


# Prices


@query
def parse_prices(spark, folder):
    return prices.parse_prices(price_entries(spark, folder))


@query
def current_prices(spark, folder):
    return prices.current_prices(*price_history(spark, folder), AS_OF, fallback_prices(spark))


@query
def current_prices_loaded(spark, folder):
    loaded = price_list(spark, folder)
    return prices.current_prices(*price_history(spark, folder), LATE, fallback_prices(spark), loaded)


@query
def current_prices_fallback(spark, folder):
    loaded = price_list(spark, folder).where(F.col("price_per_million") < 0)
    return prices.current_prices(*price_history(spark, folder), LATE, fallback_prices(spark), loaded)


@query
def price_map(spark, folder):
    return prices.price_map(price_list(spark, folder))


@query
def cost_by_model(spark, folder):
    return prices.cost_by_model(token_total(spark, folder), price_list(spark, folder))


@query
def provider_report(spark, folder):
    return prices.provider_report(token_total(spark, folder), price_list(spark, folder))


@query
def prices_in_force(spark, folder):
    """Which list was in force at each event."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    snapshots, _ = price_moments(spark, folder)
    return prices.prices_in_force(events.select("event_id", F.col("ts").alias("as_of")), snapshots).select("event_id", "fetched_at")


@query
def costs_in_force(spark, folder):
    """What each run cost under the models of the list in force at its start."""
    snapshots, entries = price_moments(spark, folder)
    runs = progress.progress_snapshot(*result_log(spark, folder))
    dated = prices.prices_in_force(runs.select("run_id", "total_tokens", F.col("started_at").alias("as_of")), snapshots)
    return prices.costs_in_force(dated, entries, fallback_prices(spark)).select("run_id", "fetched_at", "model", "cost")


# What changed between two loads


def _changes(spark, folder):
    found = []
    for spec, old, new in two_loads(spark, folder):
        before = changes.LoadedVersion(spark, _new_path(spark, f"load-{spec.table}"), 8).store(documents(old, spec))
        found.append(changes.changes(before, documents(new, spec)))
    return union_all(found)


@query
def load_changes(spark, folder):
    return _changes(spark, folder).drop("copies_before", "copies_after")


@query
def load_change_counts(spark, folder):
    return changes.change_counts(_changes(spark, folder))


# Progress


@query
def price_file(spark, folder):
    """Price files made of the parts, about a thousand entries each, written and read as one folder, a task a file."""
    entries = price_entries(spark, folder)
    files = F.lit(max(1, entries.count() // 1000))
    key = F.regexp_extract(F.to_json(F.struct(F.col("model_key").alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    line = F.struct("ordinal", F.concat(key, F.lit(": "), "entry").alias("e"))
    body = F.array_join(F.array_sort(F.collect_list(line)).getField("e"), ", ")
    path = _new_path(spark, "prices")
    made = entries.groupBy(F.pmod(F.xxhash64("ordinal"), files).alias("file")).agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
    made.write.partitionBy("file").text(path)
    return prices.parse_prices(read_price_file(spark, path)).select("provider", "model", "price_per_million")


@query
def progress_snapshot(spark, folder):
    return progress.progress_snapshot(*result_log(spark, folder))


@query
def progress_costs(spark, folder):
    snapshots = progress.progress_snapshot(*result_log(spark, folder))
    return progress.progress_costs(snapshots, price_list(spark, folder))


@query
def progress_table_lines(spark, folder):
    return progress.table_lines(result_log(spark, folder)[0])


@query
def running_progress(spark, folder):
    return progress.running_progress(*result_log(spark, folder))


@query
def progress_eta(spark, folder):
    rows = progress.running_progress(*result_log(spark, folder))
    return rows.select("run_id", "table", "eta_seconds", "eta")


@query
def changed_snapshots(spark, folder):
    rows = progress.running_progress(*result_log(spark, folder))
    changed = progress.changed_snapshots(rows, progress.SNAPSHOT, ["completed_at", "schema", "table"])
    return changed.select("run_id", "table", *progress.SNAPSHOT)


def _published(spark, folder, part, layout):
    log, runs = result_log(spark, folder)
    path = _new_path(spark, "progress")
    progress.write_progress(log, runs, price_list(spark, folder), path)
    return spark.read.schema(layout).json(f"{progress.current_version(spark, path)}/{part}")


def _flat(documents):
    """Published documents as rows."""
    return documents.select(
        F.col("runId").alias("run_id"),
        F.col("startTime").alias("start_time"),
        F.col("lastUpdate").alias("last_update"),
        "status",
        *[F.col(f"progress.{n}").alias(n) for n in ("completed", "total", "errors")],
        F.col("progress.percentComplete").alias("percent_complete"),
        F.col("totals.totalTokens").alias("total_tokens"),
        F.col("totals.totalRows").alias("total_rows"),
        F.col("elapsedSeconds").alias("elapsed_seconds"),
    )


@query
def write_progress(spark, folder):
    """The snapshots written as JSON and read back."""
    return _flat(_published(spark, folder, "snapshots", following.DOCUMENT)).drop("batch")


@query
def write_progress_tables(spark, folder):
    return _published(spark, folder, "tables", following.LINE)


@query
def write_progress_costs(spark, folder):
    return _published(spark, folder, "costs", "runId bigint, model string, cost double")


def _followed(spark, folder):
    """A log that arrived in some files, followed in several batches with a restart between them."""
    log, runs = result_log(spark, folder)
    path = _new_path(spark, "followed")
    for part in range(2):
        some = log.where(F.dayofmonth("completed_at") < 12 if part == 0 else F.dayofmonth("completed_at") >= 12)
        some.repartition(3).write.mode("append").parquet(f"{path}/log")
        following.follow_progress(
            spark, f"{path}/log", runs, fallback_prices(spark), f"{path}/out", f"{path}/state", layout=_layout(log), available_now=True, files_per_batch=2, most=2
        ).awaitTermination()
    return f"{path}/out"


def _layout(frame):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


@query
def followed_progress(spark, folder):
    """The newest document of each run that a stream has written."""
    return _flat(following.current_snapshots(spark, _followed(spark, folder)))


@query
def followed_costs(spark, folder):
    return following.current_costs(spark, _followed(spark, folder))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
