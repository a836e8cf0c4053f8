"""One query per operator of this package over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.llm import (
    bpe,
    chat_format,
    collocations,
    decontaminate,
    language_id,
    line_dedup,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    topk,
    toxicity,
    vector_codes,
)
from inktally.llm.common import given, whole_row

Query = Callable[[SparkSession, str], DataFrame]


def packed(docs: DataFrame) -> DataFrame:
    """What operators on texts read, beside the whole row as one column."""
    named = {c: F.col(f"`{c}`") for c in ("doc_id", "text", "lang") if c in docs.columns}
    return whole_row(docs, *[c.alias(k) for k, c in named.items()])


def unpacked(frame: DataFrame, docs: DataFrame) -> DataFrame:
    return frame.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_digests() -> list[Column]:
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    ]


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scanned(given(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, secrets.BASE),
        sha256(secrets.span_text(base)).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    texts = given(spark, folder, "documents").select("doc_id", F.col("text").alias("decoded"))
    return bpe.encoded_and_decoded(texts, vocabulary(), text="decoded").select("doc_id", *token_digests())


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.sharded(given(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_vectors(given(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = given(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learned(docs, given(spark, folder, "labels"))
    held_out = toxicity.in_fold(4, 2).alias("held_out")
    return toxicity.with_scores(docs, model).select("doc_id", held_out, "score", "predicted")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(given(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.without_repeats(given(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(given(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(given(spark, folder, "documents"), given(spark, folder, "benchmark"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    told = language_id.identified(given(spark, folder, "documents").select("doc_id", "text", "lang"))
    return told.select("doc_id", "held_out", "lang_pred", "score", "languages")


def tokenizer_file() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    rows = given(spark, folder, "conversations").select(*own.columns).unionByName(own)
    known = tokenizer_file()
    return chat_format.read_back(chat_format.formatted(rows, known), known)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = given(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    found, books = vector_codes.coded(vectors)
    digits = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    rows = found.select("vec_id", "label", digits.alias("code"), "error")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    whole = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.top_collocations(given(spark, folder, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_secrets,
            op2_bpe,
            op3_sharding,
            op4_topk,
            op5_toxicity,
            op6_line_dedup,
            op7_suffix_dedup,
            op8_simhash,
            op9_decontaminate,
            op10_language_id,
            op11_chat_format,
            op12_vector_codes,
            op13_collocations,
            pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": _secrets_sql(),
        "op4_topk": TOP_K,
        "op6_line_dedup": LINE_DEDUP,
        "op11_chat_format": CHAT_FORMAT,
        "op12_vector_codes": _vector_codes_sql(),
        "op13_collocations": COLLOCATIONS,
    }


def _secrets_sql() -> str:
    """Parts by the same patterns; gaps between matches give their places; a plain join of parts tells which are close."""

    def found(kind: secrets.Kind) -> str:
        pattern = "'" + kind.pattern.replace("'", "''") + "'"
        return f"""
select r, '{kind.name}' as kind, '{kind.role}' as role, {kind.least} as least, '{kind.also or ""}' as also,
  {kind.also_least} as also_least, unnest(range(1, len(m) + 1)) as n, unnest(list_slice(g, 1, len(m))) as gap,
  unnest(m) as m, unnest(v) as v
from (select r, regexp_extract_all(t, {pattern}, 0) as m, regexp_extract_all(t, {pattern}, {kind.group}) as v,
  string_split_regex(t, {pattern}) as g from docs)"""

    listed = ", ".join(f"'{k}'" for k in secrets.LISTED)
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    text = "kind || ':' || start || ':' || stop"
    order = "order by start, rank"
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE)
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(map(found, secrets.KINDS))}),
placed as (select *, sum(length(gap) + length(m)) over (partition by r, kind order by n) as stop from found),
judged as (select r, role, stop - length(m) as start, stop,
  case when length(v) >= least then kind when also <> '' and length(v) >= also_least then also end as kind from placed),
scoped as (select *, count(*) filter (kind = 'scope') over (partition by r order by start, stop, kind
  rows unbounded preceding) as scope from judged where kind is not null),
spans as (select *, list_position([{listed}], kind) as rank from scoped s where kind in ({base}) or kind <> 'scope' and exists (
  select 1 from scoped o where o.r = s.r and o.scope = s.scope and greatest(o.start - s.stop, s.start - o.stop, 0) <= {secrets.REACH}
  and (s.role = 'secret' and o.role in ('identifier', 'endpoint') or s.role in ('identifier', 'endpoint') and o.role = 'secret')))
select any_value(doc_id) as doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' {order}) filter (kind in ({base})), '')) as base_sha256,
  coalesce(string_agg({text}, ',' {order}), '') as spans
from docs left join spans using (r) group by r"""


TOP_K = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double))) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


LINE_DEDUP = r"""
with rows as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r from documents
), lines as (
  select doc_id, r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from rows
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), owners as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1
), judged as (
  select keyed.*, coalesce(keyed.doc_id <> owners.first, false) as gone from keyed left join owners using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id, r
"""


#: What each turn says, and the lengths of control strings and of backslashes put into texts that hold some.
CHAT_FORMAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written as (
  select *, length(regexp_replace(regexp_replace(role || chr(0) || text, '(<\\*)(s>|/s>|\|endoftext\|>)', '\1\\\2', 'g'),
    '(\[\\*)(INST\]|/INST\])', '\1\\\2', 'g')) - 1 + length('<s>[INST]' || '[/INST]' || '</s>') as chars
  from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from written group by conv_id
"""


def _vector_codes_sql() -> str:
    """The rounds one after the other, each a plain assignment of all parts and the means of all entries."""
    entries, parts, rounds, scale = vector_codes.ENTRIES, vector_codes.PARTS, vector_codes.ROUNDS, vector_codes.SCALE
    steps = []
    for k in range(1, rounds + 2):
        steps.append(f"""
a{k} as materialized (select row, p, any_value(part) as part, min(struct_pack(d := cast(list_sum(list_transform(
    list_zip(part, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as bigint), e := e)) as best
  from cut join c{k - 1} using (p) group by row, p)""")
        if k <= rounds:
            steps.append(f"""
m{k} as (select p, best.e as e, unnest(part) as x, generate_subscripts(part, 1) as i from a{k}),
s{k} as (select p, e, i, sum(x) as s, count(*) as n from m{k} group by p, e, i),
u{k} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{k} group by p, e),
c{k} as materialized (select p, e, coalesce(u{k}.c, old.c) as c from c{k - 1} as old left join u{k} using (p, e))""")
    return f"""
with kept as materialized (select row_number() over () as row, vec_id, label,
    list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (select row, vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) as part, v
  from kept, range({parts}) as t(p)),
first as (select *, row_number() over (partition by p order by vec_id nulls last, v) - 1 as e from cut),
c0 as materialized (select p, e, part as c from first where e < {entries}),{",".join(steps)},
coded as (select row, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' order by p) as code, cast(sum(best.d) as bigint) as error
  from a{rounds + 1} group by row),
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as digest from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, book.digest as codebooks_sha256
from kept join coded using (row), book"""


COLLOCATIONS = r"""
with texts as (
  select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents
), cut as (
  select lang, list_filter(string_split_regex(unnest(p), '[\x20\x09]+'), lambda w: w <> '') as w from texts
), grams as (
  select lang, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase, k
  from cut, range(1, 4) as t(k)
), f as materialized (
  select lang, phrase, k, count(*) as n from grams group by all
), totals as (
  select lang, sum(n) as n from f where k = 1 group by lang
), long as (
  select lang, phrase, k, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10
), cuts as (
  select *, unnest(range(1, k)) as spot from long
), scored as (
  select c.lang, c.phrase, c.k, c.a, x.n as l, y.n as r, spot,
    (1000000::hugeint * a * a) // (x.n::hugeint * y.n) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(w, 1, spot), ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(w, spot + 1, c.k), ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, spot) = 1
), kept as (
  select * from best b where not exists (select 1 from long o where o.lang = b.lang and o.k > b.k and 100 * o.a >= 50 * b.a
    and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
), ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, totals.n as n, score
  from kept join totals using (lang)
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""
