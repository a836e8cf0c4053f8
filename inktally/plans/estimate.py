"""The estimate from tables to costs, and its report."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from queue import SimpleQueue
from threading import Lock
from uuid import uuid4

from py4j.protocol import Py4JNetworkError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.operators.catalog import table_catalog, table_specs
from inktally.operators.dictionary import PieceDictionary
from inktally.operators.documents import for_each_table, narrow_page_texts, page_texts
from inktally.operators.estimates import RESULTS, listed_estimates, table_estimates, table_report, totals
from inktally.operators.prices import cost_by_model, provider_report
from inktally.operators.tokens import Tokenizer, piece_counts
from inktally.plans.chunks import Chunking
from inktally.sources.information_schema import InformationSchema
from inktally.sources.scratch import written
from inktally.sources.small import small_frame
from inktally.sources.tables import histogram_query, read_jdbc, regclass
from inktally.spec import UPDATED_AT_CANDIDATES, EstimateConfig, TableSpec

Table = tuple[DataFrame, TableSpec]

#: Texts of a table that tell whether they repeat.
LOOKED_AT = 1000


@dataclass(frozen=True)
class TableSource:
    """A table that is read when its turn comes, so that a bad one fails alone."""

    schema: str
    table: str
    load: Callable[[], Table]


def all_page_texts(
    tables: Sequence[Table], config: EstimateConfig | None = None, narrow: bool = True
) -> DataFrame:
    """The texts of all tables, a row each.

    ``narrow`` reads column files in two scans, the content columns and then
    the rows without any line; sources that cannot prune columns take one.
    """
    return for_each_table(narrow_page_texts if narrow else page_texts, tables, config)


def all_piece_counts(
    tables: Sequence[Table],
    tokenizer: Tokenizer,
    config: EstimateConfig | None = None,
    narrow: bool = True,
    repeating: Collection[str] = (),
) -> DataFrame:
    """:func:`piece_counts` of all tables, each by itself: the piece is the only key that its rows are added up by.

    In tables named in ``repeating`` equal texts are counted first, and each is cut once.
    """

    def pieces(frame: DataFrame, spec: TableSpec, config: EstimateConfig | None) -> DataFrame:
        made = (narrow_page_texts if narrow else page_texts)(frame, spec, config).select("page_content")
        if spec.name in repeating:
            made = made.groupBy("page_content").agg(F.count(F.lit(1)).alias("times"))
        counted = piece_counts(made, tokenizer, by=(), times="times" if spec.name in repeating else None)
        return counted.select(F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"), "piece", "piece_count")

    return for_each_table(pieces, tables, config)


def repeating_tables(tables: Sequence[Table], config: EstimateConfig | None = None) -> set[str]:
    """Tables of whose first texts at most half are distinct; a choice of plan, which no result depends on."""

    def repeats(table: Table) -> bool:
        texts = page_texts(*table, config).select(F.xxhash64("page_content")).limit(LOOKED_AT).collect()
        return 2 * len(set(texts)) <= len(texts)

    with ThreadPoolExecutor(8) as pool:
        return {spec.name for (_, spec), found in zip(tables, pool.map(repeats, tables), strict=True) if found}


def estimate_tables(
    tables: Sequence[Table],
    tokenizer: Tokenizer,
    config: EstimateConfig | None = None,
    narrow: bool = True,
) -> DataFrame:
    """Rows and tokens of each table, as one lazy query.

    Each text is encoded where it is read, in Arrow batches; only sums are shuffled.
    """
    counted = tokenizer.with_count(all_page_texts(tables, config, narrow))
    return listed_estimates(table_estimates(counted), _listed(counted.sparkSession, tables))


def _listed(spark: SparkSession, tables: Sequence[Table]) -> DataFrame:
    return small_frame(spark, [(spec.schema, spec.table) for _, spec in tables], "schema string, table string")


@dataclass(frozen=True)
class EstimateResult:
    """Tables, totals and costs; all lazy but ``tables``."""

    tables: DataFrame
    prices: DataFrame

    @property
    def total(self) -> DataFrame:
        return totals(self.tables)

    @property
    def cost_by_model(self) -> DataFrame:
        return cost_by_model(self.total, self.prices)

    @property
    def report(self) -> DataFrame:
        return provider_report(self.total, self.prices)

    @property
    def table_lines(self) -> DataFrame:
        done = self.tables.where(F.col("status") == "completed")
        return table_report(done)


@dataclass(frozen=True)
class ResultLog:
    """A growing table of results under ``path``, with the rows of one run marked ``run_id``.

    The progress operators read it, in batch or as a stream.
    """

    path: str
    run_id: int

    def append(self, spark: SparkSession, rows: Sequence[tuple]) -> None:
        marked = [(self.run_id, *row) for row in rows]
        spark.createDataFrame(marked, f"run_id bigint, {RESULTS}").write.mode("append").parquet(self.path)


class AllTablesFailed(RuntimeError):
    """Nothing succeeded, and not for reasons that lie in the tables."""


#: Java errors that mean a lost worker, as opposed to a table that cannot be read.
_LOST = (
    "java.io.EOFException",
    "java.net.SocketException",
    "java.lang.OutOfMemoryError",
    "org.apache.spark.ExecutorDeadException",
    "org.apache.spark.SparkExitCode",
)


def _first_line(error: BaseException) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0]


def worker_lost(error: BaseException) -> bool:
    """Whether a worker or the connection died, told by the kind of error and of its causes.

    A job that the scheduler gives up without an error of a task has neither a
    condition nor a cause.
    """
    if isinstance(error, (Py4JNetworkError, ConnectionError)):
        return True
    origin = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    if origin is None:
        return False
    gave_up = origin.getClass().getName() == "org.apache.spark.SparkException" and origin.getCause() is None
    if gave_up and not (isinstance(error, PySparkException) and error.getCondition()):
        return True
    while origin is not None:
        if origin.getClass().getName() in _LOST:
            return True
        origin = origin.getCause()
    return False


class TimeLimitPassed(RuntimeError):
    """A table took longer than its time."""


#: Seconds that a cancelled table has to end by itself before it is left behind.
GRACE = 10.0


def limited(spark: SparkSession, work: Callable[[], tuple[int, int]], limit: float | None, pool: str) -> tuple[int, int]:
    """What ``work`` gives, if it ends within ``limit`` seconds; else its jobs are cancelled by their tag.

    Its jobs share a scheduler pool with no table that runs at the same time, so
    that under ``spark.scheduler.mode=FAIR`` a large table does not hold up small
    ones.  Work that hangs outside of a job is left behind in its thread.
    """
    context, tag, ended = spark.sparkContext, f"inktally-{uuid4().hex}", []

    def inside() -> None:
        context.setLocalProperty("spark.scheduler.pool", pool)
        context.addJobTag(tag)
        try:
            ended.append((work(), None))
        except Exception as stopped:  # noqa: BLE001 - raised again below
            ended.append((None, stopped))

    thread = InheritableThread(target=inside)
    thread.daemon = True
    thread.start()
    thread.join(limit)
    if thread.is_alive():
        context.cancelJobsWithTag(tag)
        thread.join(GRACE)
        if not ended or ended[0][1] is not None:
            raise TimeLimitPassed(f"not finished within {limit:g} seconds")
    found, stopped = ended[0]
    if stopped is not None:
        raise stopped
    return found


def table_results(
    spark: SparkSession,
    sources: Iterable[TableSource],
    tokenizer: Tokenizer,
    config: EstimateConfig | None = None,
    log: ResultLog | None = None,
    narrow: bool = True,
    chunking: Chunking | None = None,
) -> DataFrame:
    """One row per table: its estimate, or the error that stopped it.

    Each table is a job of its own; ``config.parallel`` of them run at a time,
    so a bad table costs no other a second run, and one that hangs none of their
    time beyond ``config.time_limit``.  ``log`` receives each row as its table
    ends, with that time.  With ``chunking``, large tables are counted by
    chunks, which a later run does not count again.  The driver holds one small
    row per table.  Rows are listed in the order of the sources.
    """
    config = config or EstimateConfig()
    appending, pools = Lock(), SimpleQueue()
    for place in range(config.parallel):
        pools.put(f"inktally-{place}")

    def estimated(source: TableSource) -> tuple[int, int]:
        frame, spec = source.load()
        if chunking is not None and (row_count := frame.count()) >= chunking.threshold:
            return chunking.estimate(frame, spec, row_count, tokenizer, config)
        (found,) = estimate_tables([(frame, spec)], tokenizer, config, narrow).collect()
        return found["row_count"], found["token_count"]

    def run(source: TableSource) -> tuple[tuple, bool]:
        row_count, token_count, error, lost, pool = 0, 0, None, False, pools.get()
        try:
            row_count, token_count = limited(spark, lambda: estimated(source), config.time_limit, pool)
        except Exception as stopped:  # noqa: BLE001 - whatever stops one table is its result
            error, lost = _first_line(stopped), worker_lost(stopped)
        pools.put(pool)
        status = "completed" if error is None else "error"
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (source.schema, source.table, row_count, token_count, status, error, now)
        if log is not None:
            with appending:
                log.append(spark, [row])
        return row, lost

    with ThreadPoolExecutor(config.parallel) as pool:
        ended = list(pool.map(run, sources))
    rows = [row for row, _ in ended]
    if any(lost for _, lost in ended) and all(row[4] == "error" for row in rows):
        raise AllTablesFailed("; ".join(row[5] for row, lost in ended if lost))
    return spark.createDataFrame(rows, RESULTS)


def estimate_cost(
    spark: SparkSession,
    sources: Iterable[TableSource],
    tokenizer: Tokenizer,
    prices: DataFrame,
    config: EstimateConfig | None = None,
    log: ResultLog | None = None,
    narrow: bool = True,
    chunking: Chunking | None = None,
) -> EstimateResult:
    """Tokens of all tables and their cost under each price; no tables give an empty result."""
    return EstimateResult(table_results(spark, sources, tokenizer, config, log, narrow, chunking), prices)


def estimate_with_dictionary(
    tables: Sequence[Table], dictionary: PieceDictionary, config: EstimateConfig | None = None, narrow: bool = True
) -> tuple[DataFrame, int]:
    """Rows and tokens of each table, and how many pieces the dictionary had to learn for it.

    The pieces are counted once and written, then looked up.
    """
    counts = written(all_piece_counts(tables, dictionary.tokenizer, config, narrow), "pieces")
    learned = dictionary.learn(counts)
    return listed_estimates(dictionary.tokens(counts), _listed(dictionary.spark, tables)), learned


def sources_of(
    relations: InformationSchema,
    schema: str,
    read: Callable[[TableSpec], DataFrame],
    allow: Sequence[str] = ("*",),
    block: Sequence[str] = (),
    candidates: Sequence[str] = UPDATED_AT_CANDIDATES,
) -> Iterator[TableSource]:
    """The tables that a catalog describes, each read by ``read`` when its turn comes."""
    for spec in table_specs(table_catalog(relations, schema, allow, block, candidates)):
        yield TableSource(spec.schema, spec.table, lambda spec=spec: (read(spec), spec))


def jdbc_reader(
    spark: SparkSession, url: str, partitions: int, properties: Mapping[str, str] | None = None, by_key: bool = False
) -> Callable[[TableSpec], DataFrame]:
    """Reads PostgreSQL tables by ranges of their pages, whose number the catalog tells.

    ``by_key`` reads those with a key by ranges of its first column with about equally many rows instead, told by the
    database's histogram where it has one: servers before version 14 read a table whole for each range of pages.
    """

    def asked(query: str) -> list:
        return spark.read.jdbc(url, query, properties=dict(properties or {})).collect()

    def read(spec: TableSpec) -> DataFrame:
        histogram = sorted(asked(histogram_query(spec)), key=lambda row: row["place"]) if by_key and spec.pk else []
        if histogram:
            bounds = [row["bound"] for row in histogram]
            return read_jdbc(spark, url, spec, partitions, properties=properties, histogram=bounds)
        name = regclass(spec).replace("'", "''")
        (row,) = asked(f"(select greatest(relpages, 1) as pages from pg_class where oid = '{name}'::regclass) as t")
        return read_jdbc(spark, url, spec, partitions, properties=properties, pages=int(row["pages"]))

    return read
