"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.sources.scratch import SETTING, scratch_folder

#: Null doc_ids sort after all others.
LAST_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which executors have to share; ``clear_scratch`` removes it.

    Where a session of one machine names none, as in tests, it is a new one of this machine; a cluster's has to.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inktally-llm-"))
    return f"{scratch_folder(spark)}/inktally/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: fixed rows that survive lost executors."""
    path = new_path(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, label: str, keys: list[str]) -> tuple[str, str]:
    """``frame`` written to the shared folder bucketed and sorted by ``keys``: the name of its table, and its path.

    With a bucket for each shuffle partition, frames that a shuffle has dealt by ``keys`` are written and joined where they
    are. The table's name goes with the session; the files stay until ``clear_scratch``.
    """
    path = new_path(frame.sparkSession, label)
    name = f"inktally_llm_{label}_{uuid.uuid4().hex}"
    buckets = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = frame.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name, path


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bare_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def whole_row(docs: DataFrame, *needed: Column) -> DataFrame:
    """All columns in one struct ``given``, so that no name clashes with ``needed``."""
    return docs.select(F.struct(*[F.col(bare_name(c)) for c in docs.columns]).alias("given"), *needed)


def with_results(frame: DataFrame, columns: list[str], **results: Column | str) -> DataFrame:
    """The columns in ``given`` again and the results, which replace columns of the same names."""
    kept = [F.col("given").getField(c).alias(c) for c in columns if c not in results]
    return frame.select(*kept, *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in results.items()])


def replaced_text(frame: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns in ``given`` in their order, with ``text`` new and ``n_chars``, if there is one, to match."""
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return frame.select(*[new.get(c, F.col("given").getField(c).alias(c)) for c in columns])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value of bounded size; the function returned reads it in a task, with or without this package there."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shared.value)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that a worker holds few texts at a time; what it no longer needs goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
