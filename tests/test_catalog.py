import random

import duckdb
import pytest
from pyspark.sql import functions as F

from inktally.operators import catalog
from inktally.sources import information_schema as info
from inktally.sources.tables import histogram_query, jdbc_options, jdbc_predicates, key_ranges, read_table, session_specs
from inktally.spec import TableSpec, find_updated_at, is_textual


def relations(spark):
    tables = [
        ("public", "Users", "BASE TABLE"),
        ("public", "orders", "BASE TABLE"),
        ("public", "audit", "BASE TABLE"),
        ("public", "seen", "VIEW"),
        ("other", "users", "BASE TABLE"),
    ]
    columns = [
        ("public", "Users", "id", "bigint", "NO", "nextval(1)", 1),
        ("public", "Users", "name", "CHARACTER VARYING", "YES", None, 2),
        ("public", "Users", "Updated_At", "timestamp", "YES", None, 3),
        ("public", "Users", "modified_at", "timestamp", "YES", None, 4),
        ("public", "orders", "line", "integer", "NO", None, 1),
        ("public", "orders", "order_id", "uuid", "NO", None, 2),
        ("public", "orders", "tags", "ARRAY", "YES", None, 3),
        ("public", "orders", "extra", "jsonb", "YES", None, 4),
        ("public", "orders", "mood", "USER-DEFINED", "YES", None, 5),
        ("public", "audit", "note", "text", "YES", None, 1),
        ("other", "users", "id", "bigint", "NO", None, 1),
    ]
    constraints = [
        ("public", "Users", "users_pkey", "PRIMARY KEY"),
        ("public", "Users", "users_name", "UNIQUE"),
        ("public", "orders", "orders_pkey", "PRIMARY KEY"),
        ("other", "users", "users_pkey", "PRIMARY KEY"),
    ]
    usage = [
        ("public", "Users", "users_pkey", "id", 1),
        ("public", "Users", "users_name", "name", 1),
        ("public", "orders", "orders_pkey", "order_id", 1),
        ("public", "orders", "orders_pkey", "line", 2),
        ("other", "users", "users_pkey", "id", 1),
    ]
    return info.InformationSchema(
        spark.createDataFrame(tables, info.TABLES),
        spark.createDataFrame(columns, info.COLUMNS),
        spark.createDataFrame(constraints, info.CONSTRAINTS),
        spark.createDataFrame(usage, info.KEY_USAGE),
    )


def names(frame):
    return [r.table for r in frame.collect()]


def test_lists_and_choices(spark):
    found = catalog.list_tables(relations(spark).tables, "public")
    assert names(found) == ["Users", "audit", "orders"]
    assert names(catalog.select_tables(found, ["users", "AUDIT"], ["Audit"])) == ["Users"]
    assert names(catalog.select_tables(found, ["*"], ["ORDERS"])) == ["Users", "audit"]
    assert names(catalog.select_tables(found, ["*"], ["*"])) == ["Users", "audit", "orders"]
    assert names(catalog.select_tables(found, [])) == []


def test_specs_of_the_catalog(spark):
    specs = list(catalog.table_specs(catalog.table_catalog(relations(spark), "public", ["users", "orders"])))
    assert [s.table for s in specs] == ["Users", "orders"]
    users, orders = specs
    assert users.pk == ("id",) and users.updated_at == "Updated_At"
    assert orders.pk == ("order_id", "line") and orders.updated_at is None
    assert [c.pk_position for c in orders.columns] == [2, 1, None, None, None]
    assert users.columns[0].default == "nextval(1)" and not users.columns[0].nullable
    assert users.content_columns() == ["name"] and orders.content_columns() == ["order_id", "extra"]
    assert orders.content_columns("all", ["LINE"]) == ["order_id", "tags", "extra", "mood"]


def test_content_columns_as_data(spark):
    columns = catalog.table_columns(relations(spark).columns.where(F.col("table_schema") == "public"))
    found = [r.column_name for r in catalog.content_columns(columns, excluded=["NOTE"]).collect()]
    assert sorted(found) == ["extra", "name", "order_id"]


def test_updated_at_ties_take_the_later_column(spark):
    rows = [("s", "t", n, "text", "NO", None, i) for i, n in enumerate(["TS", "ts", "Ts", "modified_at"], 1)]
    columns = catalog.table_columns(spark.createDataFrame(rows, info.COLUMNS))
    assert catalog.resolve_updated_at(columns, ["gone", "ts"]).first().updated_at_column == "Ts"
    assert find_updated_at(["TS", "ts", "Ts"], ["gone", "tS"]) == "Ts"
    assert find_updated_at(["a"], ["b"]) is None


def test_textual_names():
    for name in ("TEXT", "character varying(20)", '"char"', "citext", "jsonb", "uuid"):
        assert is_textual(name)
    for name in ("integer", "ARRAY", "USER-DEFINED", "timestamp with time zone", "bytea"):
        assert not is_textual(name)


def test_catalog_of_files_round_trips(spark):
    frame = spark.createDataFrame([(1, "x")], "id bigint, note string")
    spec = TableSpec.of(frame.schema, "t", pk=("id",))
    (again,) = catalog.table_specs(catalog.table_catalog(info.of_specs(spark, [spec]), "public"))
    assert again == spec


def test_read_table_selects_the_listed_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2)], "id bigint, note string, more int").write.parquet(str(tmp_path / "t"))
    kept = spark.createDataFrame([], "note string, id bigint").schema
    assert read_table(spark, TableSpec.of(kept, "t"), str(tmp_path / "t")).columns == ["note", "id"]


def test_session_tables_leave_views_out(spark, tmp_path):
    spark.sql(f"create database if not exists shop location '{tmp_path}/shop'")
    spark.sql("create table shop.items (id int, note string) using parquet")
    spark.sql("create temporary view seen as select 1 as one")
    try:
        (spec,) = session_specs(spark, "shop", {"items": ("id",)})
        assert (spec.name, spec.pk) == ("shop.items", ("id",))
    finally:
        spark.sql("drop table shop.items")
        spark.catalog.dropTempView("seen")


def test_jdbc_options():
    spec = TableSpec("public", 'we"ird', (), ("id",))
    options = jdbc_options("jdbc:x", spec, 8, (1, 99), properties={"user": "me"})
    assert options["dbtable"] == '"public"."we""ird"' and options["fetchsize"] == "1000"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("1", "100", "8")
    assert options["user"] == "me"
    assert "partitionColumn" not in jdbc_options("jdbc:x", spec)
    parts = jdbc_predicates(spec, 3)
    assert len(parts) == 3 and '"id"' in parts[0] and parts[2].endswith("= 2")
    assert jdbc_predicates(spec, 3, 90) == [
        "ctid < '(30,0)'::tid",
        "ctid >= '(30,0)'::tid AND ctid < '(60,0)'::tid",
        "ctid >= '(60,0)'::tid",
    ]
    assert jdbc_predicates(spec, 1, 90) == ["TRUE"]


@pytest.mark.parametrize("kind", ["bigint", "varchar", "timestamp"])
def test_equal_depth_ranges(kind):
    """Each row is in one range, and ranges of a skewed key hold about equally many; another database runs the conditions."""
    draw = random.Random(kind)
    made = {
        "bigint": lambda: int(draw.lognormvariate(8, 3)) - 50,
        "varchar": lambda: draw.choice("aab'\\é") * draw.randint(1, 4) + str(draw.randrange(10**6)),
        "timestamp": lambda: f"20{draw.randint(10, 12)}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)} 0{draw.randint(0, 9)}:00:0{draw.randint(0, 9)}",
    }[kind]
    base = duckdb.connect()
    base.execute(f'create table t ("the ""key" {kind})')
    base.executemany("insert into t values (?)", [(made(),) for _ in range(2000)] + [(None,)] * 5)
    ordered = [r[0] for r in base.sql('select cast("the ""key" as varchar) from t where "the ""key" is not null order by "the ""key"').fetchall()]
    histogram = [ordered[(len(ordered) - 1) * i // 100] for i in range(101)]
    for partitions in (1, 2, 7, 100):
        parts = key_ranges('the "key', histogram, partitions)
        sizes = [base.sql(f"select count(*) from t where {part}").fetchall()[0][0] for part in parts]
        assert sum(sizes) == 2005 and len(parts) <= partitions
        if partitions == 7:
            assert max(sizes) < 2005 / 7 * 1.3
    # Rows that came after the histogram was made are in one range, too.
    base.execute("insert into t select * from t")
    assert sum(base.sql(f"select count(*) from t where {part}").fetchall()[0][0] for part in parts) == 4010


def test_ranges_of_few_bounds():
    spec = TableSpec("a'b", "t", (), ("id",))
    assert key_ranges("id", ["1", "9"], 4) == ["TRUE"]
    assert key_ranges("id", ["5"] * 20, 4) == ["(\"id\" < '5' OR \"id\" IS NULL)", "\"id\" >= '5'"]
    assert jdbc_predicates(spec, 2, 90, ["1", "5", "9"]) == key_ranges("id", ["1", "5", "9"], 2)
    assert jdbc_predicates(spec, 2, 90, []) == jdbc_predicates(spec, 2, 90)
    assert "schemaname = 'a''b'" in histogram_query(spec) and "attname = 'id'" in histogram_query(spec)


def test_tables_without_columns_are_described(spark):
    found = relations(spark)
    bare = spark.createDataFrame([("public", "bare", "BASE TABLE")], info.TABLES)
    found = info.InformationSchema(
        found.tables.unionByName(bare), found.columns, found.table_constraints, found.key_column_usage
    )
    specs = {s.table: s for s in catalog.table_specs(catalog.table_catalog(found, "public"))}
    assert specs["bare"] == TableSpec("public", "bare", ()) and len(specs["Users"].columns) == 4
