import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inktally.operators import prices
from inktally.sources.price_files import FALLBACK, PRICES, fallback_prices, load_prices, read_price_file

ENTRIES = {
    "text-embedding-x": {"mode": "embedding", "input_cost_per_token": 2e-8, "litellm_provider": "OpenAI"},
    "azure/text-embedding-x": {"mode": "embedding", "input_cost_per_token": 3e-8},
    "a/b/c": {"mode": "embedding", "input_cost_per_token": 0},
    "ada-y": {"mode": "embedding", "input_cost_per_token": 1e-7},
    "/odd": {"mode": "embedding", "input_cost_per_token": 2e-8},
    "zzz": {"mode": "embedding", "input_cost_per_token": 2e-8, "litellm_provider": 5},
    "chat-z": {"mode": "chat", "input_cost_per_token": 1e-6, "litellm_provider": "q"},
    "str-z": {"mode": "embedding", "input_cost_per_token": "1e-7", "litellm_provider": "q"},
    "none-z": {"mode": "embedding", "litellm_provider": "q"},
    "sample": "not a record",
}
EXPECTED = [
    ("openai", "text-embedding-x", 2e-8 * 1e6),
    ("azure", "text-embedding-x", 3e-8 * 1e6),
    ("a", "b/c", 0.0),
    ("openai", "ada-y", 1e-7 * 1e6),
    ("other", "/odd", 2e-8 * 1e6),
    ("other", "zzz", 2e-8 * 1e6),
]


def as_list(frame):
    return [tuple(r) for r in frame.orderBy("ordinal").select("provider", "model", "price_per_million").collect()]


def test_price_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(ENTRIES, indent=1))
    assert as_list(prices.parse_prices(read_price_file(spark, str(tmp_path / "p.json")))) == EXPECTED


def test_price_file_with_repeated_and_numeric_keys(spark, tmp_path):
    one = '{"mode": "embedding", "input_cost_per_token": %s}'
    text = "{" + ", ".join(f'"{k}": {one % c}' for k, c in (("b", 1), ("7", 2), ("a", 3), ("b", 4))) + "}"
    (tmp_path / "p.json").write_text(text)
    found = as_list(prices.parse_prices(read_price_file(spark, str(tmp_path / "p.json"))))
    assert [(m, p / 1e6) for _, m, p in found] == [("7", 2), ("b", 4), ("a", 3)]


def listed(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PRICES)


def test_last_entry_wins_but_the_label_keeps_its_own_price(spark):
    total = spark.createDataFrame([(1_500_000,)], "total_tokens bigint")
    report = prices.provider_report(total, listed(spark, EXPECTED)).orderBy("provider_ordinal", "ordinal")
    rows = [tuple(r) for r in report.collect()]
    assert [r[2] for r in rows] == ["openai", "openai", "azure", "a", "other", "other"]
    first = rows[0]
    assert first[3:6] == ("text-embedding-x", 2e-8 * 1e6, 3e-8 * 1e6)
    assert first[6] == "$0.02/1M tokens" and rows[1][6] == "$0.09999999999999999/1M tokens"
    assert rows[3][6] == "free/local" and rows[3][7] == 0
    costs = {r.model: r.cost for r in prices.cost_by_model(total, listed(spark, EXPECTED)).collect()}
    assert costs["text-embedding-x"] == 1_500_000 / 1_000_000 * (3e-8 * 1e6) and len(costs) == 5


def test_fallback_costs(spark):
    total = spark.createDataFrame([(1_500_000,)], "total_tokens bigint")
    rows = {r.model: r for r in prices.provider_report(total, fallback_prices(spark)).collect()}
    assert rows["text-embedding-3-small"].cost_text == "$0.030000"
    assert rows["text-embedding-3-large"].cost == pytest.approx(0.195)
    assert rows["all-minilm"].price_label == "free/local"
    short = prices.provider_report(total, fallback_prices(spark), digits=4)
    assert short.where("ordinal = 0").first().cost_text == "$0.0300"


def test_the_total_is_computed_once_and_no_join_is_crossed(spark):
    total = spark.range(10).agg(F.sum("id").alias("total_tokens"))
    plan = prices.provider_report(total, fallback_prices(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "ages,filled,loaded,expected",
    [
        ([timedelta(hours=23, minutes=59)], True, 2, "snapshot"),
        ([timedelta(hours=24)], True, 2, "loaded"),
        ([timedelta(hours=-1)], True, 2, "snapshot"),
        ([timedelta(hours=1)], False, 2, "empty"),
        ([], True, 0, "fallback"),
        ([timedelta(hours=30)], True, None, "fallback"),
        ([timedelta(hours=30), timedelta(hours=2), timedelta(hours=3)], True, 2, "snapshot"),
    ],
)
def test_current_prices(spark, ages, filled, loaded, expected):
    now = datetime(2024, 6, 1, 12)
    stamps = [(now - age,) for age in ages]
    snapshots = spark.createDataFrame(stamps, "fetched_at timestamp_ntz")
    rows = [(s[0], i, "p", str(s[0]), 1.0) for i, s in enumerate(stamps)] if filled else []
    entries = spark.createDataFrame(rows, "fetched_at timestamp_ntz, " + PRICES)
    fresh = None if loaded is None else listed(spark, [("q", f"new{i}", 1.0) for i in range(loaded)])
    found = [r.model for r in prices.current_prices(snapshots, entries, now, fallback_prices(spark), fresh).collect()]
    newest = [str(max(s[0] for s in stamps))] if stamps else []
    wanted = {"snapshot": newest, "loaded": ["new0", "new1"], "empty": [], "fallback": [m for _, m, _ in FALLBACK]}
    assert sorted(found) == sorted(wanted[expected])


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_age_of_a_list_does_not_follow_the_drivers_zone(spark, monkeypatch, kind):
    """A list 20 hours old is taken wherever the driver stands, and one 25 hours old nowhere."""
    import time

    for hours, wanted in ((20, ["kept"]), (25, [m for _, m, _ in FALLBACK])):
        at = f"timestamp'{datetime(2024, 6, 1, 12) - timedelta(hours=hours)}+00:00'"
        stamp = spark.range(1).select(F.expr(at).cast(kind).alias("fetched_at"))
        entries = stamp.select("fetched_at", F.lit(0).cast("bigint").alias("ordinal"), F.lit("p").alias("provider"), F.lit("kept").alias("model"), F.lit(1.0).alias("price_per_million"))
        for zone in ("America/New_York", "UTC", "Asia/Tokyo"):
            monkeypatch.setenv("TZ", zone)
            time.tzset()
            try:
                found = prices.current_prices(stamp, entries, datetime(2024, 6, 1, 12), fallback_prices(spark))
                assert sorted(r.model for r in found.collect()) == sorted(wanted)
            finally:
                monkeypatch.undo()
                time.tzset()


def test_prices_never_fail(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(ENTRIES))
    (tmp_path / "bad.json").write_text("no json")
    (tmp_path / "empty.json").write_text("{}")
    assert as_list(load_prices(spark, str(tmp_path / "good.json"))) == EXPECTED
    for name in ("bad", "empty", "absent"):
        assert [m for _, m, _ in as_list(load_prices(spark, str(tmp_path / f"{name}.json")))] == [m for _, m, _ in FALLBACK]


def test_a_loaded_list_joins_the_history(spark, tmp_path):
    paths = str(tmp_path / "snapshots"), str(tmp_path / "entries")
    now = datetime(2024, 6, 1, 12)
    prices.append_price_list(listed(spark, [("p", "old", 1.0)]), now - timedelta(hours=9), *paths)
    prices.append_price_list(listed(spark, [("p", "new", 1.0), ("p", "newer", 1.0)]), now - timedelta(hours=1), *paths)
    history = [spark.read.parquet(p) for p in paths]
    assert sorted(r.model for r in prices.current_prices(*history, now, fallback_prices(spark)).collect()) == ["new", "newer"]
