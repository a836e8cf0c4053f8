import pytest
from pyspark.sql import functions as F

from inktally.operators.documents import page_texts, union_all
from inktally.operators.estimates import table_estimates, table_report, totals
from inktally.operators.progress import progress_snapshot
from inktally.operators.tokens import CL100K_SPECIAL, Tokenizer, doc_tokens, piece_counts, piece_tokens
from inktally.plans import estimate
from inktally.plans.estimate import (
    AllTablesFailed,
    ResultLog,
    TableSource,
    all_page_texts,
    all_piece_counts,
    estimate_cost,
    estimate_tables,
    repeating_tables,
    sources_of,
    table_results,
    worker_lost,
)
from inktally.sources.information_schema import of_specs
from inktally.sources.price_files import fallback_prices
from inktally.streaming.progress import LOG
from inktally.spec import EstimateConfig, TableSpec
from workloads.tables import tables

EDGES = [
    "",
    "hello world",
    "r_name: AFRICA",
    '[public.labels] {"doc_id":"0","quality":1,"toxic":0}',
    "a　b     c d",
    "١٢٣ I'LL don’t it's",
    "<|endoftext|> hi",
    "ſo ſ's",
    "  \n\n x\t\ty  ",
    "\x0b\x85 z",
]


def texts(spark, values):
    rows = [("s", "t", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "schema string, table string, id int, page_content string").coalesce(1)


def lengths(spark, values, used):
    return [r.token_count for r in doc_tokens(texts(spark, values), used, ("id",)).orderBy("id").collect()]


def test_token_goldens(spark, tokenizer, encoder):
    found = lengths(spark, EDGES, tokenizer)
    assert found[:4] == [0, 2, 7, 22]
    assert found == [len(encoder.encode_ordinary(t)) for t in EDGES]


def test_pieces_give_the_same_totals(spark, tokenizer, encoder):
    counts = piece_counts(texts(spark, EDGES * 3), tokenizer)
    import regex

    pieces = [p for t in EDGES * 3 for p in [None, *regex.findall(tokenizer.pattern, t)]]
    assert {r.piece: r.piece_count for r in counts.collect()} == {p: pieces.count(p) for p in pieces}
    total = piece_tokens(counts, tokenizer).first()
    assert total.token_count == 3 * sum(len(encoder.encode_ordinary(t)) for t in EDGES)
    assert total.row_count == 3 * len(EDGES)


def test_pairs_are_merged(spark):
    from workloads.queries import pairs_tokenizer

    values = ["he said", "HE", "another thousand", "'the' banana he'll", "hhee ouou"]
    want = [len(v) - sum(v.count(p) for p in ("he", "an", "ou")) for v in values]
    assert lengths(spark, values, pairs_tokenizer()) == want


def test_texts_stay_out_of_python(spark, data, tokenizer):
    """Of counted pieces, only those that the vocabulary lacks go there; lineitem's first scan reads its two text columns."""
    found = piece_tokens(piece_counts(all_page_texts(tables(spark, data, ("lineitem",))), tokenizer), tokenizer)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag:string,l_linestatus:string>" in plan
    (line,) = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert "page_content" not in line and "piece" in line


def test_texts_are_not_shuffled(spark, data, tokenizer):
    """Neither estimates, nor tokens of documents, nor pieces shuffle texts or the columns they are made of."""
    read = tables(spark, data, ("lineitem", "documents"))
    made = all_page_texts(read)
    each = (estimate_tables(read, tokenizer), doc_tokens(made, tokenizer, ("schema", "table")), piece_counts(made, tokenizer))
    for frame in each:
        todo, shuffled = [frame._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.executedPlan()
            if node.nodeName() == "Exchange":
                shuffled.append(node.output().mkString(" "))
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert not any(name in out for out in shuffled for name in ("page_content", "text#", "l_returnflag", "__lines"))
        assert shuffled or frame is each[1]


def test_special_strings_can_be_refused(spark, tokenizer):
    strict = Tokenizer(tokenizer.pattern, tokenizer.ranks, refuse_special=True)
    assert strict.special == CL100K_SPECIAL
    assert lengths(spark, ["fine"], strict)[0] > 0
    with pytest.raises(Exception, match="special token"):
        lengths(spark, ["<|endoftext|>"], strict)
    with pytest.raises(ValueError, match="refuse"):
        Tokenizer(tokenizer.pattern, tokenizer.ranks, (), refuse_special=True)


def test_estimates_equal_a_plain_loop(spark, data, tokenizer, encoder):
    read = tables(spark, data)
    expected = {}
    for frame, spec in read:
        contents = [r.page_content for r in page_texts(frame, spec).collect()]
        expected[spec.table] = (len(contents), sum(len(encoder.encode_ordinary(t)) for t in contents))
    for narrow in (False, True):
        found = estimate_tables(read, tokenizer, narrow=narrow).collect()
        assert {r.table: (r.row_count, r.token_count) for r in found} == expected


def test_estimates_do_not_depend_on_partitions(spark, data, tokenizer):
    read = tables(spark, data, ("documents", "nation"))
    results = []
    for parts in (1, 2, 7):
        counts = piece_counts(union_all([page_texts(f, s) for f, s in read]).repartition(parts), tokenizer)
        results.append(sorted(map(tuple, piece_tokens(counts, tokenizer).collect())))
    shared = piece_tokens(piece_counts(all_page_texts(read), tokenizer), tokenizer)
    assert results[0] == results[1] == results[2] == sorted(map(tuple, shared.collect()))


def test_pieces_are_added_up_by_piece_alone(spark, data, tokenizer):
    """Each table by itself; the few texts of lineitem are cut once each, however many rows have them."""
    read = tables(spark, data, ("documents", "lineitem", "embeddings"))
    repeating = repeating_tables(read)
    assert repeating == {"public.lineitem"}
    found = all_piece_counts(read, tokenizer, repeating=repeating)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("keys=[")[1].split("]")[0] for x in plan.splitlines() if "HashAggregate(keys=" in x]
    assert {k.split("#")[0] for k in keys} == {"piece", "page_content"} and not any("," in k for k in keys)
    expected = sorted(map(repr, piece_counts(all_page_texts(read), tokenizer).collect()))
    assert sorted(map(repr, found.collect())) == expected
    assert sorted(map(repr, all_piece_counts(read, tokenizer).collect())) == expected


def test_sums_of_counted_documents(spark):
    counted = spark.createDataFrame([("s", "t", 3), ("s", "t", 4), ("s", "u", None)], "schema string, table string, token_count bigint")
    assert sorted(map(tuple, table_estimates(counted).collect())) == [("s", "t", 2, 7), ("s", "u", 1, 0)]


def test_empty_tables_are_listed(spark, tokenizer):
    frame = spark.createDataFrame([], "s string")
    (row,) = estimate_tables([(frame, TableSpec.of(frame.schema, "t"))], tokenizer).collect()
    assert tuple(row) == ("public", "t", 0, 0)


def test_report_has_a_total(spark):
    rows = [("s", "b", 1, 10), ("s", "a", 2, 20)]
    frame = spark.createDataFrame(rows, "schema string, table string, row_count bigint, token_count bigint")
    found = [tuple(r) for r in table_report(frame).collect()]
    assert found == [("s.a", 2, 20, 0), ("s.b", 1, 10, 0), ("TOTAL", 3, 30, 1)]
    assert [tuple(r) for r in table_report(frame.limit(0)).collect()] == [("TOTAL", 0, 0, 1)]


def sources(spark, tmp_path):
    spark.createDataFrame([("x",), ("y z",)], "s string").write.parquet(str(tmp_path / "good"))
    good = lambda: (f := spark.read.parquet(str(tmp_path / "good")), TableSpec.of(f.schema, "good"))
    frame = spark.range(3).select(F.raise_error(F.lit("broken row")).cast("string").alias("s"))
    bad = lambda: (frame, TableSpec.of(frame.schema, "bad"))
    absent = lambda: (spark.read.parquet(str(tmp_path / "absent")), None)
    return [TableSource("public", "good", good), TableSource("public", "bad", bad), TableSource("public", "absent", absent)]


def test_bad_tables_do_not_stop_the_rest(spark, tmp_path, tokenizer, encoder):
    result = estimate_cost(spark, sources(spark, tmp_path), tokenizer, fallback_prices(spark))
    rows = {r.table: r for r in result.tables.collect()}
    assert {t: r.status for t, r in rows.items()} == {"good": "completed", "bad": "error", "absent": "error"}
    assert "broken row" in rows["bad"].error_message and "absent" in rows["absent"].error_message
    tokens = sum(len(encoder.encode_ordinary(t)) for t in ("s: x", "s: y z"))
    assert tuple(result.total.first()) == (tokens, 2)
    assert result.table_lines.count() == 2 and result.report.count() == 11


def test_no_tables_give_an_empty_result(spark, tokenizer):
    result = table_results(spark, [], tokenizer)
    assert result.count() == 0 and tuple(totals(result).first()) == (0, 0)


def test_results_are_logged_one_by_one(spark, tmp_path, tokenizer):
    log = ResultLog(str(tmp_path / "log"), 7)
    loads = []
    found = sources(spark, tmp_path)
    counted = [TableSource(s.schema, s.table, lambda s=s: loads.append(s.table) or s.load()) for s in found]
    rows = table_results(spark, counted, tokenizer, EstimateConfig(parallel=2), log).collect()
    assert [r.table for r in rows] == ["good", "bad", "absent"] and sorted(loads) == ["absent", "bad", "good"]
    assert sorted(r.status for r in rows) == ["completed", "error", "error"]
    assert len({r.completed_at for r in rows}) == 3
    logged = spark.read.parquet(log.path)
    assert logged.count() == 3 and logged.schema == spark.createDataFrame([], LOG).schema
    runs = logged.groupBy("run_id").agg(F.min("completed_at").alias("started_at"), F.lit(3).alias("total"))
    (snapshot,) = progress_snapshot(logged, runs).collect()
    assert (snapshot.completed, snapshot.errors, snapshot.percent_complete, snapshot.status) == (3, 2, 100, "completed")


def test_lost_workers_are_told_by_the_kind_of_error(spark, tmp_path, tokenizer, monkeypatch):
    """Words in a table's error say nothing; an error of the connection does, if nothing else succeeds."""
    loud = spark.range(1).select(F.raise_error(F.lit("ExecutorLost worker exited unexpectedly")).cast("string").alias("s"))
    bad = TableSource("public", "loud", lambda: (loud, TableSpec.of(loud.schema, "loud")))
    (row,) = table_results(spark, [bad], tokenizer).collect()
    assert row.status == "error" and "ExecutorLost" in row.error_message

    def die(*_):
        raise ConnectionResetError("gone")

    lost = TableSource("public", "lost", die)
    with pytest.raises(AllTablesFailed, match="gone"):
        table_results(spark, [bad, lost], tokenizer)
    good = sources(spark, tmp_path)[0]
    assert table_results(spark, [good, lost], tokenizer).count() == 2
    assert not worker_lost(ValueError("x"))
    exits = spark.range(1).select(F.udf(lambda _: __import__("os")._exit(3), "string")("id").alias("s"))
    with pytest.raises(AllTablesFailed):
        table_results(spark, [TableSource("public", "exits", lambda: (exits, TableSpec.of(exits.schema, "exits")))], tokenizer)
    assert estimate.EstimateConfig().parallel == 8


def test_catalog_to_results(spark, data, tokenizer):
    read = {s.table: (f, s) for f, s in tables(spark, data, ("nation", "labels"))}
    relations = of_specs(spark, [s for _, s in read.values()])
    found = list(sources_of(relations, "public", lambda spec: read[spec.table][0]))
    assert [s.table for s in found] == ["labels", "nation"] and found[0].load()[1].pk == ("doc_id",)
    assert [r.row_count for r in table_results(spark, found, tokenizer).collect()] == [f.count() for f, _ in (read["labels"], read["nation"])]


def test_a_batch_is_not_held_as_python_texts():
    """2,000 texts of 20 KB, each twice and some null: counted once each, and at no time all of them Python's."""
    import tracemalloc

    import pyarrow as pa

    from inktally.operators.tokens import batch_lengths

    texts = pa.array([f"{i} " + "x" * 20_000 for i in range(2_000)] * 2 + [None, ""])
    seen = []

    def encode(text):
        seen.append(len(text))
        return range(len(text))

    tracemalloc.start()
    found = batch_lengths()(encode, texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found.to_pylist() == [20_000 + len(f"{i} ") for i in range(2_000)] * 2 + [None, 0]
    assert len(seen) == 2_001 and peak < 15_000_000
