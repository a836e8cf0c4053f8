"""The queries in DuckDB SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

from workloads.queries import BLOCKED, CHUNK, RESUMED, SCHEMA, THRESHOLD, UPDATED
from workloads.tables import KEYS

# Column types of the test tables: i 32-bit, l 64-bit, d double, s text, t timestamp,
# j JSON text, f list of 32-bit floats.
COLUMNS = {
    "region": "r_regionkey i, r_name s",
    "nation": "n_nationkey i, n_name s, n_regionkey i",
    "customer": "c_custkey l, c_name s, c_nationkey i, c_acctbal d, c_mktsegment s",
    "supplier": "s_suppkey l, s_name s, s_nationkey i, s_acctbal d",
    "part": "p_partkey l, p_name s, p_brand s, p_type s, p_size i, p_retailprice d",
    "orders": "o_orderkey l, o_custkey l, o_orderstatus s, o_totalprice d, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey l, l_partkey l, l_suppkey l, l_linenumber i, l_quantity d, l_extendedprice d, "
    "l_discount d, l_tax d, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id l, ts t, user_id l, event_type s, value d, props j",
    "documents": "doc_id l, text s, lang s, source s, n_chars l",
    "embeddings": "vec_id l, embedding f, label i",
    "pages": "page_id l, url s, html s",
    "benchmark": "item_id l, text s",
    "labels": "doc_id l, quality i, toxic i",
    "conversations": "conv_id l, turn l, role s, text s",
}
CHANGED = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in COLUMNS[table].split(", ")]


def _number(x: str) -> str:
    return f"rtrim(rtrim(cast(cast(cast({x} as varchar) as decimal(38,18)) as varchar),'0'),'.')"


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _json(name: str, kind: str) -> str:
    if kind == "i":
        return f"cast({name} as varchar)"
    if kind == "l":
        return f"'\"' || {name} || '\"'"
    if kind == "d":
        return _number(name)
    if kind == "t":
        return f"'\"' || {_iso(name)} || '\"'"
    if kind == "j":
        return f"cast(json({name}) as varchar)"
    if kind == "f":
        small = "regexp_replace(cast(x as varchar), 'e-0', 'e-')"
        one = f"case when x <> 0 and abs(x) < 1e-6 then {small} else {_number('x')} end"
        return f"'[' || array_to_string(list_transform({name}, lambda x: {one}), ',') || ']'"
    return f"cast(to_json({name}) as varchar)"


def _text(name: str, kind: str) -> str:
    return {"s": name, "d": _number(name), "t": _iso(name)}.get(kind) or (
        _json(name, kind) if kind in "jf" else f"cast({name} as varchar)"
    )


def _object(members: list[tuple[str, str]]) -> str:
    if not members:
        return "'{}'"
    body = " || ',' || ".join(f"'\"{n}\":' || coalesce({_json(n, k)}, 'null')" for n, k in sorted(members))
    return f"('{{' || {body} || '}}')"


def _row(table: str) -> str:
    return _object(_columns(table))


def _pk(table: str) -> str:
    kinds = dict(_columns(table))
    return _object([(n, kinds[n]) for n in KEYS[table]])


def _content(table: str, mode: str = "auto", without: tuple[str, ...] = ()) -> str:
    lines = [
        f"case when length({_text(n, k)}) > 0 then '{n}: ' || {_text(n, k)} end"
        for n, k in _columns(table)
        if n not in without and (mode == "all" or k in "sj")
    ]
    fallback = f"'[public.{table}] ' || {_row(table)}"
    if not lines:
        return fallback
    return f"coalesce(nullif(concat_ws(chr(10), {', '.join(lines)}), ''), {fallback})"


def _select_content(table: str, content: str, source: str | None = None) -> str:
    return f"select {', '.join(KEYS[table])}, {content} as page_content from {source or table}"


def _hashes(table: str) -> str:
    return (
        f"select sha256('public.{table}|' || {_pk(table)}) as doc_id, sha256({_pk(table)}) as pk_hash, "
        f"sha256({_row(table)}) as row_hash, {'true' if KEYS[table] else 'false'} as has_pk from {table}"
    )


def _documents(table: str) -> str:
    changed = f"nullif({_iso(CHANGED[table])}, '')" if table in CHANGED else "cast(null as varchar)"
    return (
        f"select sha256('public.{table}|' || {_pk(table)}) as doc_id, {_content(table)} as page_content, "
        f"'public' as schema, '{table}' as \"table\", {_pk(table)} as pk, sha256({_pk(table)}) as pk_hash, "
        f"{changed} as updated_at, sha256({_row(table)}) as row_hash, 'cost-estimate' as run_id, "
        f"{'true' if KEYS[table] else 'false'} as has_pk from {table}"
    )


def _max_pk(table: str) -> str:
    parts = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in KEYS[table])
    return f"max(concat_ws('|', {parts}))" if parts else "max(cast(null as varchar))"


def _max_changed(table: str) -> str:
    return _iso(f"max({CHANGED[table]})") if table in CHANGED else "max(cast(null as varchar))"


def _union(make) -> str:
    return " union all ".join(make(t) for t in COLUMNS)


_COUNTS = _union(lambda t: f"select 'public' as schema, '{t}' as \"table\", count(*) as row_count from {t}")

# Catalog relations with a table per user and a column per event.
_NAMES = (
    "'s' || (user_id % 3) as table_schema, "
    "case when user_id % 2 = 0 then 'Tab_' else 'tab_' end || user_id as table_name"
)
_EVENT_COLUMN = (
    "case when value >= 10 then upper(event_type || '_' || (event_id % 7)) "
    "else event_type || '_' || (event_id % 7) end"
)
_CATALOG = f"""
with tabs as (select distinct {_NAMES}, case when user_id % 5 = 0 then 'VIEW' else 'BASE TABLE' end as table_type
  from events),
listed as (select table_schema as schema, table_name as "table" from tabs
  where table_schema = '{SCHEMA}' and table_type = 'BASE TABLE'),
chosen as (select * from listed where lower("table") not in ({", ".join(f"'{b.lower()}'" for b in BLOCKED)})),
cols as (select table_schema as schema, table_name as "table", column_name, data_type, is_nullable, column_default,
  ordinal_position from (select {_NAMES}, {_EVENT_COLUMN} as column_name,
    case event_type when 'view' then 'CHARACTER VARYING' when 'signup' then 'jsonb' when 'error' then 'ARRAY'
      when 'click' then 'timestamp with time zone' when 'purchase' then 'uuid' end as data_type,
    value > 5 as is_nullable, case when event_type = 'click' then props end as column_default,
    cast(event_id as integer) as ordinal_position from events)),
cons as (select distinct {_NAMES}, 'pk_' || user_id as constraint_name, 'PRIMARY KEY' as constraint_type from events
  union all select distinct {_NAMES}, 'uq_' || user_id, 'UNIQUE' from events),
usage as (select {_NAMES}, case when event_type in ('purchase', 'signup') then 'pk_' else 'uq_' end || user_id
    as constraint_name, {_EVENT_COLUMN} as column_name, cast(event_id as integer) as ordinal_position from events),
keys as (select table_schema as schema, table_name as "table", column_name, ordinal_position as pk_position
  from cons join usage using (constraint_name, table_schema, table_name) where constraint_type = 'PRIMARY KEY'),
places as (select schema, "table", column_name, max(pk_position) as pk_position from keys group by all),
marked as (select cols.*, pk_position from cols left join places using (schema, "table", column_name)),
wanted as (select * from (values {", ".join(f"('{c.lower()}', {i})" for i, c in enumerate(UPDATED))}) as v(name, place)),
updated as (select schema, "table", column_name as updated_at_column from
  (select schema, "table", column_name, row_number() over (partition by schema, "table"
    order by place, ordinal_position desc) as n from cols join wanted on lower(column_name) = name) where n = 1)
"""

_PRICES = (
    "(select p_partkey as ordinal, p_brand as provider, p_type || ' ' || p_name as model, "
    "p_retailprice / 1000 as price_per_million from part)"
)
_TOTAL = "(select cast(sum(event_id % 7919) as bigint) as total_tokens from events)"
_PRICE_MAP = f"(select model, arg_max(price_per_million, ordinal) as price_per_million from {_PRICES} group by model)"
_COSTS = (
    f"select model, price_per_million, total_tokens, cast(total_tokens as double) / 1000000.0 * price_per_million "
    f"as cost from {_PRICE_MAP} cross join {_TOTAL}"
)

def _tokens(table: str) -> str:
    """Tokens of a text under the vocabulary of bytes and three pairs of them."""
    text = _content(table)
    pairs = " - ".join(f"(strlen({text}) - strlen(replace({text}, '{p}', ''))) // 2" for p in ("he", "an", "ou"))
    return f"strlen({text}) - {pairs}"


def _estimates(without: tuple[str, ...] = ()) -> str:
    return " union all ".join(
        f"select 'public' as schema, '{t}' as \"table\", count(*) as row_count, "
        f"cast(coalesce(sum({_tokens(t)}), 0) as bigint) as token_count from {t}"
        for t in COLUMNS
        if t not in without
    )


_LOG = """
(select user_id as run_id, 'public' as schema, 't' || event_id as "table",
  case when event_type = 'error' then 0 else event_id % 1000 end as row_count,
  case when event_type = 'error' then 0 else event_id % 7919 end as token_count,
  case when event_type = 'error' then 'error' else 'completed' end as status,
  case when event_type = 'error' then props end as error_message, ts as completed_at from events)
"""
_RUNS = "(select user_id as run_id, min(ts) as started_at, count(*) + user_id % 4 as total from events group by user_id)"
_SNAPSHOT = f"""
select run_id, case when count(*) >= total then 'completed' else 'in_progress' end as status, started_at, max(completed_at) as last_update, count(*) as completed,
  total, cast(count(*) filter (where status <> 'completed') as bigint) as errors,
  cast(floor(count(*) / total * 100 + 0.5) as bigint) as percent_complete,
  cast(sum(token_count) as bigint) as total_tokens, cast(sum(row_count) as bigint) as total_rows,
  (epoch_us(max(completed_at)) - epoch_us(started_at)) // 1000000 as elapsed_seconds
from {_LOG} join {_RUNS} using (run_id) group by run_id, started_at, total
"""
_RUNNING = f"""
select *, case when completed > 0 and total > completed then
    cast(ceil(millis / completed * (total - completed) / 1000) as bigint) end as eta_seconds from (
  select run_id, schema, "table", completed_at, started_at, total,
    count(*) over w as completed,
    cast(count(*) filter (where status <> 'completed') over w as bigint) as errors,
    cast(sum(token_count) over w as bigint) as total_tokens, cast(sum(row_count) over w as bigint) as total_rows,
    (epoch_us(completed_at) - epoch_us(started_at)) / 1000 as millis
  from {_LOG} join {_RUNS} using (run_id)
  window w as (partition by run_id order by completed_at, schema, "table" rows unbounded preceding))
"""
_STATE = "(completed, total, errors, percent_complete, total_tokens, total_rows, elapsed_seconds)"
_LINES = f"""
select run_id as "runId", schema, "table", row_count as "rowCount", token_count as "tokenCount", status,
  error_message as "errorMessage", {_iso('completed_at')} as "completedAt" from {_LOG}"""
_CLOCK = "printf('%02d:%02d', eta_seconds // 60, eta_seconds % 60)"


def _chunks(table: str, order: str, tokens: str, size: int) -> str:
    return f"""
select 'public' as schema, '{table}' as "table", 'public.{table}#' || chunk_index as chunk_id, chunk_index,
  count(*) as row_count, cast(sum(tokens) as bigint) as token_count from (
  select (row_number() over (order by {order}) - 1) // {size} as chunk_index, {tokens} as tokens from {table})
group by chunk_index
"""


_PLAN = f"""
select schema, "table", case when split then schema || '.' || "table" || '#' || i end as chunk_id,
  case when split then i end as chunk_index, case when split then i * {{size}} else 0 end as offset_start,
  cast(case when split then {{size}} end as bigint) as row_limit, n_chunks from (
  select *, unnest(range(0, n_chunks)) as i from (
    select *, row_count >= {{threshold}} as split,
      case when row_count >= {{threshold}} then cast(ceil(row_count / {{size}}) as bigint) else 1 end as n_chunks
    from ({_COUNTS})))
"""

_ARRIVED = (
    f"(select * from ({_chunks('lineitem', ', '.join(n for n, _ in _columns('lineitem')), 'l_linenumber', CHUNK)}) "
    f"union all select * from ({_chunks('customer', 'c_custkey', 'c_nationkey', CHUNK)}) "
    "where chunk_id <> 'public.customer#0')"
)
_WHOLE_PLAN = _PLAN.format(threshold=0, size=CHUNK)

# Split pieces without look-ahead: a mark is set before the last blank of a run that
# precedes other text, so that a run of blanks ends there.
_BLANK = r"[\s\x{0b}\x{85}\p{Z}]"
_INK = r"[^\s\x{0b}\x{85}\p{Z}]"
_PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\x{0b}\x{85}\p{Z}\p{L}\p{N}\x{01}]+|"
    r"[\s\x{0b}\x{85}\p{Z}]+"
)


def _pieces(table: str) -> str:
    marked = f"regexp_replace({_content(table)}, '({_BLANK})({_INK})', chr(1) || '\\1\\2', 'g')"
    pattern = _PIECES.replace("'", "''")
    return (
        f"select 'public' as schema, '{table}' as \"table\", "
        f"unnest(regexp_extract_all({marked}, '{pattern}')) as piece from {table}"
    )


_ENTRIES = """
(select p_partkey as ordinal, p_type, p_brand, p_size,
  case p_size % 6 when 0 then 'text-embedding-' || p_partkey when 1 then p_brand || '/' || p_name || '/' || p_partkey
    when 2 then '/odd' || p_partkey when 3 then 'ada-' || p_partkey when 4 then 'embedding' || p_partkey
    else 'zzz' || p_partkey end as model_key,
  cast(case when p_size % 2 = 0 then '0.0000000' || p_partkey else p_size || 'e-8' end as double) as cost from part)
"""

_NULLED = (
    "(select * replace (nullif(o_orderstatus, 'P') as o_orderstatus, case when o_orderpriority = '1-URGENT' then '' "
    "else nullif(o_orderpriority, '5-LOW') end as o_orderpriority) from orders)"
)

#: The built-in price list.
_FALLBACK = """
(values (0, 'openai', 'text-embedding-3-small', 0.02), (1, 'openai', 'text-embedding-3-large', 0.13),
  (2, 'openai', 'text-embedding-ada-002', 0.1), (3, 'cohere', 'embed-english-v3.0', 0.1),
  (4, 'cohere', 'embed-multilingual-v3.0', 0.1), (5, 'voyage', 'voyage-3-large', 0.18),
  (6, 'voyage', 'voyage-3', 0.06), (7, 'voyage', 'voyage-3-lite', 0.02), (8, 'ollama', 'nomic-embed-text', 0),
  (9, 'ollama', 'mxbai-embed-large', 0), (10, 'ollama', 'all-minilm', 0))
  as v(ordinal, provider, model, price)
"""


#: Price lists 36 hours apart, and the one in force at a moment.
_MOVED = "timestamp '2020-01-01 00:00:00' + to_hours(36 * datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate))"
_IN_FORCE = (
    f"(select max({_MOVED}) from lineitem where {_MOVED} <= {{at}} and {_MOVED} > {{at}} - interval 24 hours)"
)

_ORDER_CHANGE = "case when o_orderkey % 5 = 0 then 'Z' else o_orderstatus end"
_CHANGED_ORDERS = f"""
with sides as (select o_orderkey % 7 <> 0 as was, o_orderkey % 11 <> 0 as here, sha256('public.orders|' || {_pk('orders')}) as doc_id,
    sha256({_row('orders')}) as old_hash, new_hash
  from orders join (select o_orderkey as k, sha256({_row('orders')}) as new_hash from (select * replace ({_ORDER_CHANGE} as o_orderstatus)
    from orders)) on k = o_orderkey)
select 'public' as schema, 'orders' as "table", doc_id, case when here then new_hash else old_hash end as row_hash,
  case when not was then 'added' when not here then 'removed' else 'changed' end as change, 1 as n
from sides where (was or here) and (was is distinct from here or old_hash <> new_hash)"""
_CHANGED_ITEMS = f"""
select 'public' as schema, 'lineitem' as "table", sha256('public.lineitem|' || {_pk('lineitem')}) as doc_id, sha256(line) as row_hash,
  case when now > was then 'added' else 'removed' end as change, abs(now - was) as n from (
  select {_row('lineitem')} as line, count(*) filter (l_linenumber <> 2) as was,
    count(*) filter (l_linenumber <> 3) + count(*) filter (l_linenumber = 4) as now from lineitem group by 1) where was <> now"""
_CHANGES = f"(select * from ({_CHANGED_ORDERS}) union all select * from ({_CHANGED_ITEMS}))"


def oracle_sql() -> dict[str, str]:
    return {
        "list_tables": _CATALOG + "select * from listed",
        "select_tables": _CATALOG + "select * from chosen",
        "table_columns": _CATALOG + "select * from cols",
        "primary_keys": _CATALOG + "select * from keys",
        "annotate_pk": _CATALOG + "select * from marked",
        "resolve_updated_at": _CATALOG + "select * from updated",
        "table_catalog": _CATALOG
        + 'select marked.*, updated_at_column from marked join chosen using (schema, "table") '
        'left join updated using (schema, "table")',
        "content_columns": _CATALOG
        + "select * from cols where lower(column_name) <> 'view_1' and (lower(data_type) like '%char%' "
        "or lower(data_type) like '%text%' or lower(data_type) like '%json%' or lower(data_type) like '%uuid%')",
        "read_table_orders": "select * from orders",
        "table_row_count": _COUNTS,
        "table_max_updated_at": _union(
            lambda t: f"select '{t}' as \"table\", {_max_changed(t)} as max_updated_at from {t}"
        ),
        "table_max_pk": _union(lambda t: f"select '{t}' as \"table\", {_max_pk(t)} as max_pk from {t}"),
        "table_snapshot": _union(
            lambda t: f"select 'public' as schema, '{t}' as \"table\", count(*) as row_count, "
            f"{_max_changed(t)} as max_updated_at, {_max_pk(t)} as max_pk_lexicographic from {t}"
        ),
        "table_snapshot_statistics": _union(
            lambda t: f"select 'public' as schema, '{t}' as \"table\", count(*) as row_count, "
            f"{_max_changed(t)} as max_updated_at, {_max_pk(t)} as max_pk_lexicographic from {t}"
        )
        + " union all select 'public', 'orders_by_day', count(*), strftime(max(o_orderdate), '%Y-%m-%dT00:00:00.000Z'), "
        "max(cast(o_orderkey as varchar)) from orders",
        "large_tables": f"select * from ({_COUNTS}) where row_count >= {THRESHOLD}",
        "chunk_plan": _PLAN.format(threshold=THRESHOLD, size=CHUNK),
        "ordered_slice": "select * from orders order by o_orderkey limit 300 offset 1000",
        "deep_slice": "select * from events order by event_id limit 90 offset 900",
        "slice_lineitem": "select * from lineitem order by all limit 1000 offset 3000",
        "bounded_scan": "select * from events order by event_id offset 500",
        "chunk_estimates": _chunks("orders", "o_orderkey", f"length({_content('orders')})", 1000),
        "merge_chunks": f"""
select schema, "table", cast(sum(row_count) as bigint) as row_count, cast(sum(token_count) as bigint) as token_count
from {_ARRIVED} join (select distinct schema, "table", n_chunks from ({_WHOLE_PLAN})) using (schema, "table")
group by schema, "table", n_chunks having count(distinct chunk_id) = n_chunks""",
        "chunk_progress": f"""
select schema, "table", completed_chunks, n_chunks as total_chunks, completed_chunks || '/' || n_chunks as label from (
  select schema, "table", n_chunks, count(distinct a.chunk_id) as completed_chunks
  from (select distinct schema, "table", n_chunks from ({_WHOLE_PLAN})) left join {_ARRIVED} a using (schema, "table")
  group by all)""",
        "resumed_chunks": " union all ".join(
            f"select *, 1 as arrived from ({_chunks(t, ', '.join(KEYS[t]) or 'all', _tokens(t), n)})" for t, n in RESUMED.items()
        ).replace("order by all", f"order by {', '.join(n for n, _ in _columns('lineitem'))}"),
        "resumed_estimates": f"select * from ({_estimates()}) where \"table\" in ({', '.join(repr(t) for t in RESUMED)})",
        "range_slices": "select 'orders' as \"table\", o_orderkey as first, o_orderkey as last from (select * from orders "
        "order by o_orderkey limit 900 offset 700) union all select 'lineitem', l_orderkey, l_linenumber from "
        "(select * from lineitem order by all limit 1000 offset 3000)",
        "dictionary_estimates": f"select *, 0 as learned from ({_estimates()})",
        "table_results_by_chunks": f"select *, 'completed' as status from ({_estimates()}) "
        "where \"table\" in ('nation', 'customer', 'events', 'pages')",
        "table_results_one_missing": "select schema, \"table\", row_count, status from (select *, 'completed' as status from "
        f"({_COUNTS}) where \"table\" in ('region', 'documents')) union all select 'public', 'absent', 0, 'error'",
        "prices_in_force": f"select event_id, {_IN_FORCE.format(at='ts')} as fetched_at from events",
        "costs_in_force": f"""
with runs as (select run_id, total_tokens, started_at, {_IN_FORCE.format(at='started_at')} as fetched_at from ({_SNAPSHOT}) s),
lists as (select {_MOVED} as dated, 'p' || l_partkey as model, arg_max(l_extendedprice / 1000, l_orderkey * 10 + l_linenumber) as price
  from lineitem group by 1, 2 union all select null, model, cast(price as double) from {_FALLBACK})
select run_id, fetched_at, model, cast(total_tokens as double) / 1000000.0 * price as cost
from runs join lists on fetched_at is not distinct from dated""",
        "load_changes": f"select schema, \"table\", doc_id, row_hash, change from {_CHANGES}",
        "load_change_counts": "select schema, \"table\", " + ", ".join(
            f"cast(coalesce(sum(n) filter (change = '{c}'), 0) as bigint) as {c}" for c in ("added", "removed", "changed")
        ) + f" from {_CHANGES} group by all",
        "followed_costs": f"""
select run_id as "runId", model, cast(total_tokens as double) / 1000000.0 * cast(price as double) as cost
from ({_SNAPSHOT}) s, {_FALLBACK}""",
        "page_content_customer": _select_content("customer", _content("customer")),
        "page_content_all_columns": _select_content("orders", _content("orders", "all")),
        "page_content_excluded": _select_content("orders", _content("orders", without=("o_orderstatus",))),
        "page_content_nulls": _select_content("orders", _content("orders"), _NULLED),
        "page_content_narrow": _union(
            lambda t: f"select 'public' as schema, '{t}' as \"table\", {_content(t)} as page_content from {t}"
        ),
        "total_of_rows": f"select cast(sum(row_count) as bigint) as total_rows from ({_COUNTS})",
        "fallback_content_labels": _select_content("labels", _content("labels")),
        "fallback_content_embeddings": _select_content("embeddings", _content("embeddings")),
        "canonical_json_orders": f"select o_orderkey, {_row('orders')} as row_json from orders",
        "canonical_json_lineitem": f"select {_row('lineitem')} as row_json from lineitem",
        "canonical_json_events": f"select event_id, {_row('events')} as row_json from events",
        "extract_pk": f"select conv_id, turn, {_pk('conversations')} as pk from conversations",
        "hashes_nation": _hashes("nation"),
        "hashes_conversations": _hashes("conversations"),
        "hashes_lineitem": _hashes("lineitem"),
        "updated_at_value": f"select event_id, {_iso('ts')} as updated_at from events",
        "all_documents": _union(_documents),
        "canonical_json_numbers": f"""
select p_partkey, '{{"a":[' || p_partkey || ',0,100,"v1.2"],"b":' || {_number('p_retailprice')} ||
  ',"c":{{"y":12345678901234568,"z":' || {_number('p_retailprice')} || '}}}}' as row_json from part""",
        "canonical_json_nested": f"""
with made as (select event_id, cast(json(props) as varchar) as props, {_number('value')} as value,
  cast(cast(cast('1234567890123' || lpad(cast(event_id % 10000 as varchar), 4, '0') || '0' as double) as varchar)
    as decimal(38,0)) as large from events),
parts as (select *, '{{"x":["1.50",' || value || ',2.5e-7,1e+22],"y":' || value || '}}' as loose from made)
select event_id, '{{"event_id":"' || event_id || '","list":[' || props || ',' || loose || ',null],"map":{{"9":' || large || ',"10":' ||
  loose || '}},"tree":{{"a":[[' || loose || ']],"b":{{"value":' || value || ',"z":' || large || '}}}}}}' as row_json from parts""",
        "doc_tokens_pairs": f"select doc_id, {_tokens('documents')} as token_count from documents",
        "chunk_tokens_pairs": _chunks("documents", "doc_id", _tokens("documents"), 100),
        "piece_counts": 'select schema, "table", piece, count(*) as piece_count from ('
        + _union(_pieces)
        + f') group by all union all select schema, "table", null, row_count from ({_COUNTS})',
        "piece_tokens_pairs": _estimates(),
        "table_estimates_pairs": _estimates(),
        "total_of_tokens_pairs": f"select cast(sum(token_count) as bigint) as total_tokens from ({_estimates()})",
        "table_report_pairs": 'with lines as (select schema || \'.\' || "table" as name, row_count, token_count '
        f"from ({_estimates()})) select name, row_count, token_count, 0 as is_total from lines union all "
        "select 'TOTAL', cast(sum(row_count) as bigint), cast(sum(token_count) as bigint), 1 from lines",
        "table_results_pairs": f"select *, 'completed' as status, false as has_error from ({_estimates()}) "
        "union all select 'public', 'absent', 0, 0, 'error', true",
        "estimate_from_catalog": f"select *, 'completed' as status from ({_estimates(('labels',))})",
        "embedding_cost_pairs": f"""
select provider, model, cost, '$' || printf('%.6f', cost) as cost_text from (
  select provider, model, cast(total as double) / 1000000.0 * cast(price as double) as cost
  from {_FALLBACK}, (select sum(token_count) as total from ({_estimates()})))""",
        "price_file": f"""
select case when p_size % 5 = 0 then lower(p_brand) when instr(model_key, '/') > 1
    then lower(split_part(model_key, '/', 1)) when p_size % 6 in (0, 3, 4) then 'openai' else 'other' end as provider,
  case when instr(model_key, '/') > 1 then substr(model_key, instr(model_key, '/') + 1) else model_key end as model,
  cost * 1000000.0 as price_per_million from {_ENTRIES}
where p_size % 7 <> 0 and p_type not in ('LARGE', 'SMALL')""",
        "table_report_characters": 'with lines as (select schema || \'.\' || "table" as name, count(*) as row_count, '
        "cast(sum(n) as bigint) as token_count from ("
        + _union(lambda t: f"select 'public' as schema, '{t}' as \"table\", length({_content(t)}) as n from {t}")
        + ") group by 1) select name, row_count, token_count, 0 as is_total from lines union all "
        "select 'TOTAL', cast(sum(row_count) as bigint), cast(sum(token_count) as bigint), 1 from lines",
        "parse_prices": f"""
select ordinal, case when p_size % 5 = 0 then lower(p_brand) when instr(model_key, '/') > 1
    then lower(split_part(model_key, '/', 1)) when p_size % 6 in (0, 3, 4) then 'openai' else 'other' end as provider,
  case when instr(model_key, '/') > 1 then substr(model_key, instr(model_key, '/') + 1) else model_key end as model,
  cost * 1000000.0 as price_per_million from {_ENTRIES}
where p_size % 7 <> 0 and p_type not in ('LARGE', 'SMALL')""",
        "current_prices": """
select l_orderkey * 10 + l_linenumber as ordinal, 's' || l_suppkey as provider, 'p' || l_partkey as model,
  l_extendedprice / 1000 as price_per_million from lineitem where l_shipdate = (select max(l_shipdate) from lineitem
  where l_shipdate > timestamp '2000-05-31 12:00:00')""",
        "current_prices_loaded": f"select * from {_PRICES} where (select max(l_shipdate) from lineitem) <= "
        "timestamp '2029-12-31 00:00:00'",
        "current_prices_fallback": "select cast(ordinal as bigint) as ordinal, provider, model, cast(price as double) "
        f"as price_per_million from {_FALLBACK} where (select max(l_shipdate) from lineitem) <= "
        "timestamp '2029-12-31 00:00:00'",
        "price_map": f"select * from {_PRICE_MAP}",
        "cost_by_model": _COSTS,
        "provider_report": f"""
select provider_ordinal, ordinal, provider, p.model, p.price_per_million, c.price_per_million as effective_price,
  case when p.price_per_million = 0 then 'free/local' else '$' || {_number('p.price_per_million')} || '/1M tokens' end
    as price_label, c.cost, '$' || printf('%.6f', c.cost) as cost_text
from {_PRICES} p join ({_COSTS}) c on p.model = c.model
join (select provider, min(ordinal) as provider_ordinal from {_PRICES} group by provider) using (provider)""",
        "progress_snapshot": _SNAPSHOT,
        "progress_costs": f"""
select run_id, model, cast(total_tokens as double) / 1000000.0 * price_per_million as cost
from ({_SNAPSHOT}) s, {_PRICE_MAP} p""",
        "progress_table_lines": _LINES,
        "write_progress_tables": _LINES,
        "write_progress_costs": f"""
select run_id as "runId", model, cast(total_tokens as double) / 1000000.0 * price_per_million as cost
from ({_SNAPSHOT}) s, {_PRICE_MAP} p""",
        "running_progress": f"""
select run_id, schema, "table", completed_at, completed, total, errors,
  cast(floor(completed / total * 100 + 0.5) as bigint) as percent_complete, total_tokens, total_rows,
  cast(floor(millis / 1000) as bigint) as elapsed_seconds, eta_seconds, {_CLOCK} as eta from ({_RUNNING})""",
        "progress_eta": f'select run_id, "table", eta_seconds, {_CLOCK} as eta from ({_RUNNING})',
        "changed_snapshots": f"""
select run_id, "table", completed, total, errors, percent_complete, total_tokens, total_rows, elapsed_seconds from (
  select *, lag({_STATE}) over (partition by run_id order by completed_at, schema, "table") as before, {_STATE} as state
  from (select *, cast(floor(completed / total * 100 + 0.5) as bigint) as percent_complete,
    cast(floor(millis / 1000) as bigint) as elapsed_seconds from ({_RUNNING})))
where before is null or before <> state""",
        "followed_progress": f"""
select run_id, {_iso('started_at')} as start_time, {_iso('last_update')} as last_update, status, completed, total,
  errors, percent_complete, total_tokens, total_rows, elapsed_seconds from ({_SNAPSHOT})""",
        "write_progress": f"""
select run_id, {_iso('started_at')} as start_time, {_iso('last_update')} as last_update, status, completed, total,
  errors, percent_complete, total_tokens, total_rows, elapsed_seconds from ({_SNAPSHOT})""",
    }
