"""Secrets in texts, and parts of credentials that are told by standing together.

Spans that are secrets by themselves: assigned passwords and tokens, access identifiers, long hex strings.
Weak parts alone say nothing: short assigned values, user or client names, short access identifiers,
addresses of services. They are linked by an interval join: a weak part is reported only if a complementary
part, strong or weak, stands within ``reach`` code points in the same scope, a paragraph (blank lines end one).
Complementary are a secret and an identifier, and a secret and an endpoint. The join looks at the nearest
part before and after, in one pass over a document's parts in order; no pairs are made.

Everything is a built-in function; only the places of parts are shuffled, not the texts.

Defined results: a null text is empty and has no spans; places count code points, ends are exclusive; of spans
that start together, the kind listed first comes first; repeated rows are returned as often as given, and
rows that share a doc_id are told apart by their texts; a null doc_id is kept; no rows give no rows. Only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 300
#: Copies of a row that a task writes out at a time.
COPIES = 10_000


def either_case(text: str) -> str:
    """A pattern for a text in any case, without the letters that other engines fold to ASCII ones."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


def _names(*names: str) -> str:
    return "|".join(map(either_case, names))


@dataclass(frozen=True)
class Kind:
    """A kind of part: its pattern (group 1 is the value, or all of it), the value's least length, its role.

    Of an assignment, group 1 is the value. ``also``: the kind that a value of ``also_least`` and more, but
    under ``least``, is.
    """

    name: str
    pattern: str
    least: int
    role: str
    group: int = 0
    also: str | None = None
    also_least: int = 0


_IS = r"""["']?\x20*[:=]\x20*["']?"""
#: The first three patterns and lengths are given.
KINDS = (
    Kind(
        "assign",
        f"(?:{_names('password', 'passwd', 'secret', 'token')}|{either_case('api')}_?{either_case('key')}){_IS}([A-Za-z0-9+/_.=-]+)",
        12, "secret", 1, "weak_secret", 6,
    ),
    Kind("access", "AKIA[A-Z0-9]+", 18, "identifier", 0, "weak_access", 8),
    Kind("hex", "[0-9a-f]{16,}", 16, "secret"),
    Kind(
        "weak_identifier",
        f"(?:{_names('username', 'user_name', 'client_id', 'clientid', 'access_key_id', 'account_id', 'login')}){_IS}[A-Za-z0-9_.@+-]+",
        0, "identifier",
    ),
    Kind(
        "weak_endpoint",
        r"(?:https?|ftps?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
        0, "endpoint",
    ),
    Kind("scope", r"\n[\x20\x09]*\n", 0, "scope"),
)
#: All reported kinds, in the order in which ties are listed.
LISTED = ("assign", "access", "hex", "weak_secret", "weak_access", "weak_identifier", "weak_endpoint")
BASE = LISTED[:3]


def _found(kind: Kind) -> Column:
    """Texts between matches and the matches, as lengths: an array of (gap, match, value)."""
    gaps = F.transform(F.split("body", kind.pattern, -1), F.length)
    whole = F.regexp_extract_all("body", F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all("body", F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    some = F.arrays_zip(
        F.slice(gaps, 1, F.size(whole)).alias("gap"),
        F.transform(whole, F.length).alias("match"),
        F.transform(value, F.length).alias("value"),
    )
    # Most texts hold no match; one look spares them the rest.
    empty = F.array().cast("array<struct<gap:int,match:int,value:int>>")
    return F.when(F.rlike("body", F.lit(kind.pattern)), some).otherwise(empty)


def _rows_of(kind: Kind) -> Column:
    """A kind's matches in a text, numbered."""
    name = F.lit(kind.name).alias("kind")
    fields = ("gap", "match", "value")
    return F.transform(_found(kind), lambda m, i: F.struct(name, i.alias("nth"), *[m[f].alias(f) for f in fields]))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, copies, kind, role, start, end) of all parts; a row without kind for each different row of ``docs``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    texts = texts.select("doc_id", "body", F.xxhash64("body").alias("row"))
    each = [_rows_of(k) for k in KINDS]
    none = F.lit(None)
    row = F.struct(
        none.cast("string").alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("match"), F.lit(0).alias("value")
    )
    listed = texts.select("doc_id", "row", F.inline(F.concat(F.array(row), *each)))
    before = Window.partitionBy("doc_id", "row", "kind").orderBy("nth")
    # Equal rows have equal parts, which are counted before they are shuffled: many copies are a row per task.
    counted = listed.groupBy(*listed.columns).agg(F.count("*").alias("copies"))
    placed = counted.withColumn("end", F.sum(F.col("gap") + F.col("match")).over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "start", F.col("end") - F.col("match")
    )
    kind, role = F.col("kind"), F.lit(None).cast("string")
    judged = F.when(kind.isNull(), None)
    for k in KINDS:
        role = F.when(kind == k.name, k.role).otherwise(role)
        weaker = F.when(F.col("value") >= k.also_least, k.also) if k.also else F.lit(None)
        judged = judged.when(kind == k.name, F.when(F.col("value") >= k.least, k.name).otherwise(weaker))
    known = placed.select("doc_id", "row", "copies", judged.alias("kind"), role.alias("role"), "start", "end", kind.isNull().alias("marker"))
    return known.where("marker or kind is not null")


def linked(found: DataFrame, reach: int) -> DataFrame:
    """The parts that are reported: strong ones, and weak ones with a complementary part within reach.

    Adds ``partner_start``: where the nearest complementary part starts, null if there is none.
    """
    doc = Window.partitionBy("doc_id", "row").orderBy("start", "end", F.coalesce("kind", F.lit("")))
    scoped = found.withColumn("scope", F.sum(F.when(F.col("kind") == "scope", 1).otherwise(0)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    place = [F.col("start"), F.col("end"), F.coalesce("kind", F.lit(""))]
    scope = Window.partitionBy("doc_id", "row", "scope")
    # Looked at backwards, what comes after comes before; both windows take one step a part.
    earlier = [scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (place, [p.desc() for p in place])]
    near = {}
    for role in ("secret", "identifier", "endpoint"):
        # Before a part the nearest is the one that ends last, which need not start last; after it, the one that starts first.
        ending = F.when(F.col("role") == role, F.struct("end", "start"))
        near[role] = [F.max(ending).over(earlier[0]), F.last(ending, True).over(earlier[1])]
    wide = scoped.select("*", *[c.alias(f"{role}_{n}") for role, both in near.items() for n, c in enumerate(both)])

    def within(role: str) -> list[Column]:
        """Distance and place of the nearest part of a role on either side, null beyond reach."""
        before, after = F.col(f"{role}_0"), F.col(f"{role}_1")
        gaps = [(F.greatest(F.col("start") - before["end"], F.lit(0)), before), (F.greatest(after["start"] - F.col("end"), F.lit(0)), after)]
        return [F.when(side.isNotNull() & (gap <= reach), F.struct(gap.alias("gap"), side["start"].alias("start"))) for gap, side in gaps]

    complements = {"secret": ["identifier", "endpoint"], "identifier": ["secret"], "endpoint": ["secret"]}
    partner = F.lit(None).cast("struct<gap:bigint,start:bigint>")
    for role, others in complements.items():
        options = [c for o in others for c in within(o)]
        partner = F.when(F.col("role") == role, F.least(*options)).otherwise(partner)
    out = wide.withColumn("partner", partner).withColumn("partner_start", F.col("partner.start"))
    reported = F.col("marker") | F.col("kind").isin(*BASE) | ((F.col("kind") != "scope") & F.col("partner").isNotNull())
    return out.where(reported).select("doc_id", "row", "copies", "marker", "kind", "start", "end", "partner_start")


def scanned(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans) of each row: the reported parts in order, as (kind, start, end, partner_start)."""
    rank = F.array_position(F.array(*map(F.lit, LISTED)), F.col("kind"))
    span = F.when(
        ~F.col("marker"), F.struct("start", rank.alias("rank"), "end", "kind", "partner_start")
    )
    of_row = linked(parts(docs), reach).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.max("copies").alias("copies"))
    # As often as given: blocks of copies first, so that no array is as long as their number.
    of_row = of_row.withColumn("block", F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}L))")).repartition("doc_id", "row", "block")
    of_row = of_row.withColumn("copy", F.expr(f"explode(sequence(1L, least({COPIES}L, copies - block * {COPIES}L)))"))
    kept = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["partner_start"].alias("partner_start")))
    return of_row.select("doc_id", kept.alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
