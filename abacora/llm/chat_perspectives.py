"""Multi-party perspective rotation: each dialogue rendered once per participant.

For every participant of a conversation its turns are rendered with that speaker as assistant and
every other speaker as a named user; turns of a context role (system) stay context and take no
perspective. The result has a row per turn and perspective: the rendered segment, its character
range within the whole rendering and the range that the loss mask covers (the assistant's words and
end mark; null elsewhere). Segments in order of start, joined by nothing, are the rendering.

Marks within texts and roles are escaped, so that no text can forge a turn: `<`, any number of backslashes and `|`
get one backslash more before the `|`, which unescape() takes off again.

Only DataFrame functions are used. Offsets are prefix sums in three levels (turn and a prefix of the
text's digest; 256 turns; conversation), so no task gets all turns of a long conversation, and
repeated rows are counted once and laid out by arithmetic. Texts cross one shuffle.

Edge cases: a null role is the speaker 'unknown', a null text the empty text; null conv_ids form one
conversation; null turns come first; rows of equal turn are ordered by the MD5 of role and text;
repeated rows are each rendered, numbered by `copy`; a conversation of context turns alone has no
participant and gives no rows; columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
BLOCK = 256
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _head(role: Column, perspective: Column, context: Column) -> Column:
    name = escape(role)
    return F.when(context, F.concat(F.lit("<|"), name, F.lit("|>\n"))).when(role == perspective, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null; right's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"_{k}" for k in keys])


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, turn, role, copy, segment, seg_start, seg_end, mask_start, mask_end."""
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.coalesce(conversations["role"].cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws("\n", "role", "text"))).withColumn("text", escape(F.col("text")))
    lean = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    people = lean.filter(~F.col("role").isin(*context_roles)).groupBy("conv_id", F.col("role").alias("perspective")).agg(F.lit(1).alias("_one")).drop("_one")
    context = F.col("role").isin(*context_roles)
    seen = _same(lean, people, ["conv_id"]).withColumn("width", F.length(_head(F.col("role"), F.col("perspective"), context)) + F.col("chars") + len(END))
    seen = seen.withColumn("total", F.col("width") * F.col("n")).withColumn("part", F.substring("digest", 1, 2))

    fine, block, whole = ["conv_id", "perspective", "turn", "part"], ["conv_id", "perspective", "block"], ["conv_id", "perspective"]
    before = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    level1 = seen.withColumn("off1", before("total", Window.partitionBy(*fine).orderBy("digest")))
    sums2 = seen.groupBy(*fine).agg(F.sum("total").alias("sum2")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    level2 = sums2.withColumn("off2", before("sum2", Window.partitionBy(*block).orderBy(F.asc_nulls_first("turn"), "part")))
    sums3 = sums2.groupBy(*block).agg(F.sum("sum2").alias("sum3"))
    level3 = sums3.withColumn("off3", before("sum3", Window.partitionBy(*whole).orderBy(F.asc_nulls_first("block"))))
    blocks = _same(level2.select(*fine, "block", "off2"), level3.select(*block, "off3"), block)
    placed = _same(level1, blocks.select(*fine, (F.col("off2") + F.col("off3")).alias("off23")), fine).withColumn("base", F.col("off1") + F.col("off23"))
    texts = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    out = _same(texts, placed.select("conv_id", "turn", "role", "digest", "perspective", "n", "width", "base"), ["conv_id", "turn", "role", "digest"])
    head = _head(F.col("role"), F.col("perspective"), context)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("base") + F.col("copy") * F.col("width")
    mine = ~context & (F.col("role") == F.col("perspective"))
    return out.select(
        "conv_id", "perspective", "turn", "role", "copy",
        F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
        start.alias("seg_start"), (start + F.col("width")).alias("seg_end"),
        F.when(mine, start + F.length(head)).alias("mask_start"), F.when(mine, start + F.col("width")).alias("mask_end"),
    )


_SQL = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
ORACLE = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT *, md5(role || chr(10) || text) AS digest FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, digest) - 1 AS copy FROM d),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
s AS (SELECT k.*, p.perspective,
        CASE WHEN k.role = 'system' THEN '<|' || {_SQL("k.role")} || '|>' || chr(10)
             WHEN k.role = p.perspective THEN '<|assistant|>' || chr(10)
             ELSE '<|user name=' || {_SQL("k.role")} || '|>' || chr(10) END AS head
      FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (SELECT *, head || {_SQL("text")} || '<|end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, digest, copy ROWS UNBOUNDED PRECEDING) AS seg_end FROM w)
SELECT conv_id, perspective, turn, role, copy, segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
       CASE WHEN role = perspective THEN CAST(seg_end - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = perspective THEN CAST(seg_end AS BIGINT) END AS mask_end
FROM o
"""
