import hashlib
import json
import math
import random
import struct
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions.json_text import canonical_text, number_text, quote, with_canonical_json
from inktally.functions.numbers import js_number, to_fixed
from inktally.functions.values import iso_millis, json_document_text, json_string_sql, lower_hex_sql
from inktally.operators.documents import RowText, documents, narrow_page_texts, page_texts
from inktally.spec import EstimateConfig, TableSpec


def texts(spark, values, kind="double", single=False):
    frame = spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1)
    return [r.t for r in frame.select(js_number("x", single).alias("t")).collect()]


def test_number_goldens(spark):
    values = [1.0, 0.1, 1e7, 1e21, 1e-7, -0.0, math.nan, 1e-6, -1.5e-9, 2e23, math.inf, -math.inf, None, 123456789.25]
    expected = [
        "1", "0.1", "10000000", "1e+21", "1e-7", "0", "NaN", "0.000001", "-1.5e-9", "2e+23", "Infinity", "-Infinity",
        None, "123456789.25",
    ]
    assert texts(spark, values) == expected


def test_numbers_match_an_independent_formatter(spark):
    random.seed(7)
    values = [random.uniform(-1e8, 1e8) for _ in range(4000)]
    values += [round(random.uniform(0, 1e5), 2) for _ in range(4000)]
    values += [random.choice((-1, 1)) * 10 ** random.uniform(-12, 15) for _ in range(4000)]
    assert texts(spark, values) == [number_text(v) for v in values]


def test_random_bit_patterns_seldom_differ(spark):
    # The JVM prints a few very large numbers with another last digit: a known deviation.
    random.seed(8)
    values = [struct.unpack("d", struct.pack("Q", random.getrandbits(64)))[0] for _ in range(20000)]
    values = [v for v in values if math.isfinite(v)]
    wrong = [v for v, t in zip(values, texts(spark, values)) if t != number_text(v)]
    assert len(wrong) < 20 and all(abs(v) > 2**53 or abs(v) < 1e-300 for v in wrong)


def test_single_floats_print_their_short_form(spark):
    assert texts(spark, [0.1, 1.5, -0.0, 3.0, 1e-5], "float", True) == ["0.1", "1.5", "0", "3", "0.00001"]


def test_single_floats_between_two_short_forms_print_exactly(spark):
    """19/1024 is as near to 0.018554688 as to 0.018554687; both read back as it, neither is nearer."""
    made = [19 / 1024, -3891921.25, 1561016.75, 1365.03125, 0.0009765625, 0.018554689362645149]
    expected = ["0.0185546875", "-3891921.25", "1561016.75", "1365.03125", "0.0009765625", "0.01855469"]
    assert texts(spark, made, "float", True) == expected
    import numpy as np

    rng = np.random.default_rng(7)
    some = (rng.integers(1, 2**23, 3000) / 2.0 ** rng.integers(3, 12, 3000)).astype("f4")
    printed = texts(spark, [float(x) for x in some], "float", True)
    assert all(np.float32(t) == x for t, x in zip(printed, some))


@pytest.mark.parametrize("digits", [4, 6])
def test_to_fixed_rounds_by_exact_value(spark, digits):
    random.seed(9)
    values = [5e-7, 1.5e-6, 0.03, -1e-7, 128.8629465, 1.0000005]
    values += [random.randrange(10**9) / 2e6 for _ in range(3000)] + [random.uniform(0, 1e6) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    found = [r.t for r in frame.select(to_fixed(F.col("x"), digits).alias("t")).collect()]

    def expected(value):
        exact = Decimal(abs(value)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
        return ("-" if value < 0 else "") + format(exact, "f")

    assert found == [expected(v) for v in values]


def test_dates_and_times(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-01-02 03:04:05.678901' a, timestamp'2024-01-02 03:04:05.6+02:00' b, "
        "date'2024-01-02' c, timestamp_ntz'0999-12-31 23:59:59' d, cast(null as timestamp) e"
    )
    kinds = {f.name: f.dataType for f in row.schema.fields}
    expected = {
        "a": "2024-01-02T03:04:05.678Z",
        "b": "2024-01-02T01:04:05.600Z",
        "c": "2024-01-02T00:00:00.000Z",
        "d": "0999-12-31T23:59:59.000Z",
        "e": None,
    }
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = row.select(*[iso_millis(n, k, spark).alias(n) for n, k in kinds.items()]).first().asDict()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found == expected


def test_json_strings_escape_like_javascript(spark):
    values = [chr(i) + 'a\\u001F"\\\\u001B' for i in range(40)] + [" é😀/", "", "}", '"}']
    frame = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    made = frame.select(F.expr(json_string_sql("x")).alias("j")).select(F.expr(lower_hex_sql("j")).alias("j"))
    assert [r.j for r in made.collect()] == [quote(v) for v in values]


def test_json_documents(spark):
    documents_ = {
        '{"b":1,"a":{"d":2,"c":[3,{"z":1,"y":2}]}}': '{"a":{"c":[3,{"y":2,"z":1}],"d":2},"b":1}',
        '{"10":1,"9":2}': '{"9":2,"10":1}',
        "[1e7,1.50,-0,12345678901234567890]": "[10000000,1.5,0,12345678901234567000]",
        '{"a":null,"a":2}': '{"a":2}',
        '{"b":null}': '{"b":null}',
        '"x\\u001Fy"': '"x\\u001fy"',
        " [ true , false ] ": "[true,false]",
        "null": "null",
    }
    frame = spark.createDataFrame([(d,) for d in documents_], "d string").coalesce(1)
    made = with_canonical_json(frame, F.col("d"), "c")
    assert [r.c for r in made.collect()] == list(documents_.values())
    assert [canonical_text(d) for d in documents_] == list(documents_.values())
    shown = made.select(json_document_text(F.col("c")).alias("t")).collect()
    assert [r.t for r in shown][-3:] == ["x\x1fy", "[true,false]", None]


def test_numbers_in_json_documents(spark):
    """Usual numbers stay with the built-in writer; all come out as the plain function writes them."""
    rng = random.Random(6)
    made = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-9, 12) for _ in range(300)]
    texts = [repr(x) for x in made] + [f"{x:.{rng.randint(0, 12)}f}" for x in made]
    texts += ["-0", "-0.0", "0", "0.0", "0.1", "-0.5", "10.10", "0.000001", "0.00000123", "123456789012345", "1234567890123456", "1e5"]
    found = [f'{{"v1.20": "1.50 x\\" 2e3", "n": [{t}]}}' for t in texts] + ['"' + "\\n" * 20000 + '"', '"' + "a" * 200000 + '"']
    frame = spark.createDataFrame([(t,) for t in found], "d string")
    rows = with_canonical_json(frame, F.col("d"), "c").collect()
    assert [(r.d, r.c) for r in rows] == [(t, canonical_text(t)) for t in found]


def test_canonical_json_is_free_of_key_order(spark):
    random.seed(3)
    for _ in range(50):
        keys = random.sample("abcdefghij", 5)
        record = {k: random.choice([1, "x", None, [1, 2], {"q": 1, "p": 2}]) for k in keys}
        shuffled = {k: record[k] for k in sorted(keys, reverse=True)}
        assert canonical_text(json.dumps(record)) == canonical_text(json.dumps(shuffled))


WIDE = T.StructType(
    [
        T.StructField("b", T.LongType()),
        T.StructField("a", T.StringType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("n", T.DecimalType(12, 2)),
        T.StructField("t", T.TimestampNTZType()),
        T.StructField("l", T.ArrayType(T.LongType())),
        T.StructField("w", T.ArrayType(T.FloatType())),
        T.StructField("o", T.StructType([T.StructField("z", T.LongType()), T.StructField("y", T.StringType())])),
        T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("x", T.BinaryType()),
        T.StructField("k", T.BooleanType()),
        T.StructField("i", T.IntegerType()),
    ]
)


def wide(spark):
    full = (
        7, 'q"', 1e7, Decimal("12.50"), datetime(2024, 1, 2), [1, None], [0.1, None, 1.0, 0.0001], (5, "é"),
        {"q": 1, "p": 2}, b"\x00\xff", True, 3,
    )
    return spark.createDataFrame([full, (None,) * len(full)], WIDE).coalesce(1)


def test_row_json_of_every_type(spark):
    frame = wide(spark)
    row = RowText(frame, TableSpec.of(WIDE, "t"))
    found = [r.j for r in row.full.select(row.row_json.alias("j")).collect()]
    assert found[0] == (
        '{"a":"q\\"","b":"7","f":10000000,"i":3,"k":true,"l":["1",null],"m":{"p":2,"q":1},"n":"12.50",'
        '"o":{"y":"é","z":5},"t":"2024-01-02T00:00:00.000Z","w":[0.1,null,1,0.0001],"x":{"0":0,"1":255}}'
    )
    assert found[1] == "{" + ",".join(f'"{n}":null' for n in sorted(WIDE.names)) + "}"


def test_all_mode_lines(spark):
    frame = wide(spark)
    made = page_texts(frame, TableSpec.of(WIDE, "t"), EstimateConfig(mode="all")).collect()
    assert made[0].page_content.split("\n") == [
        "b: 7", 'a: q"', "f: 10000000", "n: 12.50", "t: 2024-01-02T00:00:00.000Z", 'l: ["1",null]',
        "w: [0.1,null,1,0.0001]", 'o: {"y":"é","z":5}', 'm: {"p":2,"q":1}', 'x: {"0":0,"1":255}', "k: true", "i: 3",
    ]
    assert made[1].page_content.startswith('[public.t] {"a":null,')


def test_intervals(spark):
    frame = spark.sql("select interval '1 02:00:03.5' day to second a, interval '1-2' year to month b")
    row = RowText(frame, TableSpec.of(frame.schema, "t"))
    assert row.full.select(row.row_json.alias("j")).first().j == (
        '{"a":{"days":1,"hours":2,"milliseconds":500,"seconds":3},"b":{"months":2,"years":1}}'
    )


def test_region_goldens(spark):
    frame = spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string")
    spec = TableSpec.of(frame.schema, "region", pk=("r_regionkey",))
    row = documents(frame, spec).first()
    assert row.page_content == "r_name: AFRICA"
    assert row.row_hash == "494ebccd422aa4f93d75d3a3c32595f0a465da383ce3b04229b941df1d9e59fa"
    assert row.pk_hash == "9c903d04f57c54ecf903551fbb192d40290e93996f51ffc3d78516967136bee2"
    assert row.doc_id == "aeb02074ec8dd1e9be990a65bacb66f5ba90533e1e05627b175d11eaf575bb5d"
    assert (row.pk, row.run_id, row.has_pk, row.updated_at) == ('{"r_regionkey":0}', "cost-estimate", True, None)
    everything = page_texts(frame, spec, EstimateConfig(mode="all")).first()
    assert everything.page_content == "r_regionkey: 0\nr_name: AFRICA"


def test_keys_composite_and_absent(spark):
    frame = spark.createDataFrame([(0, 0, "user")], "conv_id bigint, turn bigint, role string")
    row = documents(frame, TableSpec.of(frame.schema, "conversations", pk=("conv_id", "turn"))).first()
    assert row.doc_id == "9f981ce185ad863b66b6a927e88493349d51be2914a1a4b8a571210700936553"
    none = documents(frame, TableSpec.of(frame.schema, "lineitem")).first()
    assert none.pk_hash == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    assert none.doc_id == "823a4a7100265f88719b43627510d7015712a645aa515f74f6f834cfd52ac310"
    assert not none.has_pk
    with pytest.raises(ValueError, match="public.t has no column absent"):
        documents(frame, TableSpec.of(frame.schema, "t", pk=("absent",)))


def test_blank_empty_and_null_cells(spark):
    frame = spark.createDataFrame([("", None, " ")], "a string, b string, c string")
    assert page_texts(frame, TableSpec.of(frame.schema, "t")).first().page_content == "c:  "


def test_fallback_keeps_excluded_columns_unless_redacted(spark):
    frame = spark.createDataFrame([(None, "x")], "a string, secret string")
    spec = TableSpec.of(frame.schema, "t")
    leak = EstimateConfig(excluded=("SECRET",))
    assert page_texts(frame, spec, leak).first().page_content == '[public.t] {"a":null,"secret":"x"}'
    safe = EstimateConfig(excluded=("SECRET",), redact_fallback=True)
    assert page_texts(frame, spec, safe).first().page_content == '[public.t] {"a":null}'
    assert documents(frame, spec, safe).first().page_content == '[public.t] {"a":null}'
    whole = hashlib.sha256(b'{"a":null,"secret":"x"}').hexdigest()
    assert documents(frame, spec, safe).first().row_hash == whole


def test_updated_at(spark):
    frame = spark.createDataFrame([(1, "2024-05-01"), (2, ""), (3, None)], "id int, Updated_At string").coalesce(1)
    spec = TableSpec.of(frame.schema, "t", pk=("id",))
    assert [r.updated_at for r in documents(frame, spec).collect()] == ["2024-05-01", None, None]


def test_row_hash_changes_with_any_value(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.5), (2, "a", 0.5), (1, "b", 0.5), (1, "a", 0.25), (1, None, 0.5)]
    frame = spark.createDataFrame(rows, "i int, s string, d double").coalesce(1)
    hashes = [r.row_hash for r in documents(frame, TableSpec.of(frame.schema, "t")).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 5


@pytest.mark.parametrize("types", [None, {"j": "jsonb"}])
def test_narrow_scan_gives_the_same_texts(spark, types, tmp_path):
    rows = [("x", '{"b":1,"a":2}', 1.0), ("", None, 2.0), (None, '""', 3.0), ("", "null", 4.0), (None, None, 5.0)]
    spark.createDataFrame(rows, "a string, j string, d double").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    spec = TableSpec.of(frame.schema, "t", types=types)
    one, two = page_texts(frame, spec), narrow_page_texts(frame, spec)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    scans = two._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<a:string,j:string>")
    assert scans == 1


def test_whole_numbers_beyond_2_to_the_53(spark):
    """The nearest of the shortest digits, against the exact binary value, up to where exponents begin."""
    import random
    import struct

    from inktally.functions.json_text import number_text
    from inktally.functions.numbers import js_number

    rng = random.Random(12)
    some = [rng.choice((1, -1)) * rng.uniform(2**53, 10 ** rng.uniform(16, 21)) for _ in range(20_000)]
    some += [float(2**k + d * 2 ** max(0, k - 52)) for k in range(53, 70) for d in (-1, 0, 1)] + [float(10**k) for k in range(16, 21)]
    some += [struct.unpack("d", struct.pack("Q", (rng.randrange(1076, 1093) << 52) | rng.getrandbits(52)))[0] for _ in range(5_000)]
    some = [x for x in some if 2**53 <= abs(x) < 1e21]
    frame = spark.createDataFrame(list(enumerate(some)), "i int, x double")
    found = {r.i: r.t for r in frame.select("i", js_number("x").alias("t")).collect()}
    wrong = [(x, found[i], number_text(x)) for i, x in enumerate(some) if found[i] != number_text(x)]
    assert not wrong, wrong[:5]


def test_variants_at_any_depth(spark):
    """A cell with variants inside prints as one JSON document, whose other parts keep their forms."""
    loose = ['{"10": 1.50, "9": [1e2, -0.0, 1E22], "b": null}', "12345678901234567890", '"1.50 \\u001f"', "[]", "null", None]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(loose)], "k long, d string").coalesce(1)
    variant = "try_parse_json(d)"
    made = frame.selectExpr(
        "k",
        f"array({variant}, null) as l",
        f"map('2', array({variant}), '11', null) as m",
        f"if(k = 3, null, named_struct('w', k, 'v', {variant}, 'n', cast(k as decimal(9,1)), 'x', unhex('00ff'))) as s",
    )
    spec = TableSpec.of(made.schema, "t", pk=("k",))
    row = RowText(made, spec, EstimateConfig(mode="all"))
    found = row.full.select("k", row.row_json.alias("j"), "page_content").orderBy("k").collect()
    for (k, j, content), document in zip(found, loose, strict=True):
        inner = "null" if document is None else canonical_text(document)
        tree = f'{{"n":{k},"v":{inner},"w":{k},"x":{{"0":0,"1":255}}}}' if k != 3 else None
        assert j == f'{{"k":"{k}","l":[{inner},null],"m":{{"2":[{inner}],"11":null}},"s":{tree or "null"}}}'
        lines = [f"k: {k}", f"l: [{inner},null]", f'm: {{"2":[{inner}],"11":null}}'] + ([f"s: {tree}"] if tree else [])
        assert content == "\n".join(lines)
    assert made.where("false").count() == 0 and RowText(made.where("false"), spec).full.count() == 0
