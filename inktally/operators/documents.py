"""Rows to documents: text, identity and content hashes, as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions import values
from inktally.functions.json_text import with_canonical_json
from inktally.spec import EstimateConfig, TableSpec


class RowText:
    """The texts of one table's rows.

    ``texts`` is the table with ``page_content``; ``full`` also has the row and
    its key as canonical JSON, for the properties below.  What a query does not
    select is pruned, down to the scan.
    """

    def __init__(self, frame: DataFrame, spec: TableSpec, config: EstimateConfig | None = None):
        self.spec = spec
        self.config = config or EstimateConfig()
        self._kinds = {f.name: f.dataType for f in frame.schema.fields}
        self._utc = values.in_utc(frame.sparkSession)
        for name in spec.pk:
            if name not in self._kinds:
                raise ValueError(f"{spec.name} has no column {name}, which its key names")
        for column in spec.columns:
            if column.name not in self._kinds:
                raise ValueError(f"Missing column {column.name} in {spec.name}")
        # JSON documents in canonical form, each made once.
        self._documents = {
            c.name: f"__json_{place}"
            for place, c in enumerate(spec.columns)
            if values.is_document(self._kinds[c.name], c.type_name)
        }
        rows = frame
        for name, made in self._documents.items():
            source = f"{made}_source"
            rows = rows.withColumn(source, values.document_source(name, self._kinds[name], self._utc))
            rows = with_canonical_json(rows, F.col(source), made)
        # Used twice by the text, so computed in a step of its own.
        self.rows = rows.withColumn("__lines", self._lines())

    @property
    def texts(self) -> DataFrame:
        """The rows with ``page_content``; the JSON of a row with lines is not made."""
        if not self.content_columns:
            made = self.rows.withColumn("__bare", F.expr(self._json(self._fallback_columns())))
            return made.withColumn("page_content", self._fallback(values.lower_hex_sql("__bare")))
        json = values.lower_hex_sql(self._json(self._fallback_columns()), checked=False)
        return self.rows.withColumn("page_content", self._content(self._fallback(json)))

    @property
    def full(self) -> DataFrame:
        """The rows with ``page_content`` and the JSON of row and key."""
        names = {
            "__row": [c.name for c in self.spec.columns],
            "__bare": self._fallback_columns(),
            "__pk": self.spec.pk,
        }
        made = self.rows.withColumns({k: F.expr(self._json(v)) for k, v in names.items()})
        made = made.withColumns({k: F.expr(values.lower_hex_sql(k)) for k in names})
        whole = names["__row"] == names["__bare"]
        return made.withColumn("page_content", self._content(self._fallback("__row" if whole else "__bare")))

    @staticmethod
    def cell(name: str) -> Column:
        return F.col(values.cell(name))

    def text(self, name: str) -> Column:
        """One cell as document text."""
        if name in self._documents:
            return values.json_document_text(F.col(self._documents[name]))
        return values.text_value(name, self._kinds[name], self._utc)

    def _json(self, names: Iterable[str]) -> str:
        return values.json_object_sql(
            [
                (n, self._documents[n], None)
                if n in self._documents
                else (n, values.cell(n), self._kinds[n])
                for n in names
            ],
            self._utc,
        )

    @property
    def content_columns(self) -> list[str]:
        return self.spec.content_columns(self.config.mode, self.config.excluded)

    def _fallback_columns(self) -> list[str]:
        names = [c.name for c in self.spec.columns]
        if self.config.redact_fallback:
            hidden = {name.lower() for name in self.config.excluded}
            names = [n for n in names if n.lower() not in hidden]
        return names

    def is_plain_text(self, name: str) -> bool:
        return isinstance(self._kinds[name], T.StringType) and name not in self._documents

    def may_be_empty(self, name: str) -> bool:
        """Whether a value that is not null can have an empty text."""
        return isinstance(self._kinds[name], T.StringType) or name in self._documents

    def _lines(self) -> Column:
        made = []
        for name in self.content_columns:
            value = self.text(name)
            line = F.concat(F.lit(f"{name}: "), value)
            made.append(F.when(value != "", line) if self.may_be_empty(name) else line)
        return F.concat_ws("\n", *made) if made else F.lit("")

    @property
    def lines(self) -> Column:
        """``name: value`` of each content column with a value that is not empty."""
        return F.col("__lines")

    def _fallback(self, json: str) -> Column:
        """Text of a row without lines: the table's name and the row as JSON.

        The row is whole, excluded columns included, unless ``redact_fallback``.
        """
        return F.concat(F.lit(f"[{self.spec.name}] "), F.expr(json))

    def _content(self, fallback: Column) -> Column:
        return F.when(self.lines != "", self.lines).otherwise(fallback)

    @property
    def bare_texts(self) -> DataFrame:
        """Only the rows without lines, with ``page_content``."""
        made = self.rows.where(self.lines == "").withColumn("__bare", F.expr(self._json(self._fallback_columns())))
        return made.withColumn("page_content", self._fallback(values.lower_hex_sql("__bare")))

    @property
    def row_json(self) -> Column:
        return F.col("__row")

    @property
    def row_hash(self) -> Column:
        return F.sha2(self.row_json, 256)

    @property
    def pk_json(self) -> Column:
        return F.col("__pk")

    @property
    def pk_hash(self) -> Column:
        return F.sha2(self.pk_json, 256)

    @property
    def doc_id(self) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.spec.name}|"), self.pk_json), 256)

    @property
    def updated_at(self) -> Column:
        if self.spec.updated_at is None:
            return F.lit(None).cast("string")
        value = self.text(self.spec.updated_at)
        return F.when(value != "", value)


def documents(frame: DataFrame, spec: TableSpec, config: EstimateConfig | None = None) -> DataFrame:
    """One document per row, with its identity, hashes and run id.

    A table without a key gives all rows one ``doc_id``; ``has_pk`` tells.
    """
    row = RowText(frame, spec, config)
    return row.full.select(
        row.doc_id.alias("doc_id"),
        "page_content",
        F.lit(spec.schema).alias("schema"),
        F.lit(spec.table).alias("table"),
        row.pk_json.alias("pk"),
        row.pk_hash.alias("pk_hash"),
        row.updated_at.alias("updated_at"),
        row.row_hash.alias("row_hash"),
        F.lit(row.config.run_id).alias("run_id"),
        F.lit(bool(spec.pk)).alias("has_pk"),
    )


def page_texts(frame: DataFrame, spec: TableSpec, config: EstimateConfig | None = None) -> DataFrame:
    """Only the text of each row, with its table: what token counting reads."""
    texts = RowText(frame, spec, config).texts
    return texts.select(
        F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"), "page_content"
    )


def narrow_page_texts(
    frame: DataFrame, spec: TableSpec, config: EstimateConfig | None = None
) -> DataFrame:
    """:func:`page_texts` in two scans, for wide tables in column files.

    The first scan reads the content columns only.  The second reads the whole
    row, for the rows whose content columns are all empty; its filter reaches
    the scan, where row-group statistics rule out nearly everything.  Use it on
    files that do not change between the scans.
    """
    row = RowText(frame, spec, config)
    names = row.content_columns
    if not names or len(names) == len(spec.columns):
        return page_texts(frame, spec, config)
    table = (F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"))
    full = row.rows.where(row.lines != "").select(*table, row.lines.alias("page_content"))
    # Not more than the rows without lines: those of documents are settled by the text itself.
    blank = [row.cell(n).isNull() | (row.cell(n) == "") for n in names if row.is_plain_text(n)]
    blank += [row.cell(n).isNull() for n in names if not row.may_be_empty(n)]
    bare = RowText(frame.where(reduce(lambda a, b: a & b, blank, F.lit(True))), spec, config)
    return full.unionByName(bare.bare_texts.select(*table, "page_content"))


def for_each_table(
    make: Callable[[DataFrame, TableSpec, EstimateConfig | None], DataFrame],
    tables: Sequence[tuple[DataFrame, TableSpec]],
    config: EstimateConfig | None = None,
) -> DataFrame:
    """What ``make`` gives for each table, in one DataFrame.

    Each table is analysed by itself, so the driver does several at a time.
    """
    with ThreadPoolExecutor(8) as pool:
        return union_all(list(pool.map(lambda table: make(*table, config), tables)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """One DataFrame of several with the same columns, as a balanced tree of unions."""
    frames = list(frames)
    if not frames:
        raise ValueError("no DataFrames to union")
    while len(frames) > 1:
        frames = [
            frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i]
            for i in range(0, len(frames), 2)
        ]
    return frames[0]
