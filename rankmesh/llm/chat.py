"""Preference formatting: two conversations, one prompt, two masked completions.

The turns that a chosen and a rejected conversation have in common from the start
are rendered once, as the prompt; what follows on either side is its completion.
Masks are ranges of code points in prompt plus completion, of the turns to learn
from. DataFrame operations only; rows are dealt out once, by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles whose turns are learnt from.
LEARNT = ("assistant",)


def escaped(text: Column) -> Column:
    """A text whose markers are broken up: a backslash more follows each < that a | follows, backslashes between them or none."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


#: How a role spells the characters that markers are made of.
ROLE = (("\\", "\\b"), ("<", "\\l"), ("|", "\\p"), (">", "\\g"))


def escaped_role(role: Column) -> Column:
    """A role without any character that markers are made of, so that it can't forge a turn."""
    for plain, spelt in ROLE:
        role = F.replace(role, F.lit(plain), F.lit(spelt))
    return role


def unescaped_role(role: Column) -> Column:
    """What ``escaped_role`` was given."""
    for plain, spelt in reversed(ROLE):
        role = F.replace(role, F.lit(spelt), F.lit(plain))
    return role


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), escaped_role(F.coalesce(role, F.lit(""))), F.lit("|>\n"))


def render(role: Column, text: Column) -> Column:
    """One turn. Markers that the text or the role itself holds are broken up, so that no turn can forge another; ``unescaped`` gives them back."""
    return F.concat(header(role), escaped(F.coalesce(text, F.lit(""))), F.lit("<|end|>\n"))


def _joined(pieces: Column) -> Column:
    """Pieces (pos, s) in order of pos, as one string."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(pieces)), lambda p: p["s"]), "")


def _spans(pieces: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(pieces)), lambda p: p["s"]), ",")


def preferences(chosen: DataFrame, rejected: DataFrame, learnt: Sequence[str] = LEARNT) -> DataFrame:
    """Rows (pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, tie), one for each pair.

    Both inputs have pair_id, turn, role and text; other columns are ignored. Turns
    are in order of turn, then role and text, nulls first, and repeated rows are
    turns of their own. Two turns are common if role and text agree, nulls with
    nulls. A null text is rendered as empty, a null role too. A side without turns
    has an empty completion; equal conversations are all prompt, and a tie. A null
    pair_id is a pair like any other. Masks are "begin-end" ranges joined by
    commas, in code points from the start of the prompt; they take in a learnt
    turn's text and its end mark, not its header. No rows give none.
    """
    sides = [df.select("pair_id", F.lit(k).alias("side"), "turn", "role", "text") for k, df in enumerate((chosen, rejected))]
    rows = sides[0].unionByName(sides[1]).repartition("pair_id")
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(*order)))
    turn = F.struct(F.lit(1).alias("there"), "role", "text", render(F.col("role"), F.col("text")).alias("s"))
    both = rows.groupBy("pair_id", "pos").agg(*(F.max(F.when(F.col("side") == k, turn)).alias(c) for k, c in enumerate("cr")))
    same = F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text")) & F.col("c").isNotNull() & F.col("r").isNotNull()
    pair = Window.partitionBy("pair_id")
    before = pair.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"n_common": F.coalesce(F.min(F.when(~same, F.col("pos"))).over(pair) - 1, F.max("pos").over(pair))} | {f"{c}_at": F.coalesce(F.sum(F.char_length(f"{c}.s")).over(before), F.lit(0)) for c in "cr"})
    common = F.col("pos") <= F.col("n_common")

    def piece(c: str) -> Column:
        return F.struct("pos", F.col(f"{c}.s").alias("s"))

    def mask(c: str) -> Column:
        begin, end = F.col(f"{c}_at") + F.char_length(header(F.col(f"{c}.role"))), F.col(f"{c}_at") + F.char_length(f"{c}.s")
        span = F.struct("pos", F.concat_ws("-", begin.cast("string"), end.cast("string")).alias("s"))
        return _spans(F.when(~common & F.col(f"{c}.role").isin(*learnt), span))

    return both.groupBy("pair_id").agg(
        F.max("n_common").cast("long").alias("n_common"),
        _joined(F.when(common, piece("c"))).alias("prompt"),
        _joined(F.when(~common & F.col("c").isNotNull(), piece("c"))).alias("chosen"),
        _joined(F.when(~common & F.col("r").isNotNull(), piece("r"))).alias("rejected"),
        mask("c").alias("chosen_mask"),
        mask("r").alias("rejected_mask"),
        F.min(same).alias("tie"),
    )


def with_foreign_reply(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Rejected conversations for ``turns`` (conv_id, turn, role, text): the last reply comes from another conversation.

    Each conversation is cut after its last turn of ``role``, whose text becomes
    that of the last such turn of the conversation with the neighbouring id (the
    lowest bit flipped); where that has none, the turn is left out. A conversation
    without such a turn stays as it is. Rows: pair_id, turn, role, text.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    turns = turns.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    mine = F.col("role") == role
    last = F.max(F.when(mine, F.col("pos"))).over(Window.partitionBy("conv_id"))
    turns = turns.withColumn("last", last)
    foreign = turns.filter(mine & (F.col("pos") == F.col("last"))).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("of"), F.coalesce("text", F.lit("")).alias("reply"))
    at_last = F.coalesce(F.col("pos") == F.col("last"), F.lit(False))
    kept = turns.filter(F.col("last").isNull() | (F.col("pos") <= F.col("last")))
    kept = kept.join(foreign, F.col("conv_id") == F.col("of"), "left").filter(~at_last | F.col("reply").isNotNull())
    return kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(at_last, F.col("reply")).otherwise(F.col("text")).alias("text"))


def foreign_reply_preferences(turns: DataFrame) -> DataFrame:
    """Every conversation as the chosen one, against itself with a foreign last reply."""
    return preferences(turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"), with_foreign_reply(turns))


#: The same rows in DuckDB.
FOREIGN_REPLY_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
u AS (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS last FROM t),
f AS (SELECT xor(conv_id, 1) AS of_id, coalesce(text, '') AS reply FROM u WHERE role = 'assistant' AND pos = last),
rej AS (
  SELECT u.conv_id, u.turn, u.role, CASE WHEN u.pos = u.last THEN f.reply ELSE u.text END AS text
  FROM u LEFT JOIN f ON u.conv_id = f.of_id
  WHERE (u.last IS NULL OR u.pos <= u.last) AND (u.pos IS DISTINCT FROM u.last OR f.reply IS NOT NULL)),
s AS (SELECT conv_id, 0 AS side, turn, role, text FROM conversations UNION ALL SELECT conv_id, 1, turn, role, text FROM rej),
p AS (
  SELECT conv_id, side, role, text, head,
         head || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS s,
         row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT *, '<|' || replace(replace(replace(replace(coalesce(role, ''), '\', '\b'), '<', '\l'), '|', '\p'), '>', '\g') || '|>' || chr(10) AS head FROM s)),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
d AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.pos, r.pos) AS pos,
         c.s IS NOT NULL AND r.s IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (SELECT * FROM o WHERE side = 0) c FULL JOIN (SELECT * FROM o WHERE side = 1) r
    ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.pos = r.pos),
k AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS n_common, bool_and(same) AS tie FROM d GROUP BY conv_id)
SELECT k.conv_id AS pair_id, CAST(k.n_common AS BIGINT) AS n_common,
  coalesce(string_agg(CASE WHEN side = 0 AND pos <= n_common THEN s END, '' ORDER BY pos), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 0 AND pos > n_common THEN s END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 1 AND pos > n_common THEN s END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN side = 0 AND pos > n_common AND role = 'assistant' THEN CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(s) AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN side = 1 AND pos > n_common AND role = 'assistant' THEN CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(s) AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS rejected_mask,
  k.tie
FROM k JOIN o ON k.conv_id IS NOT DISTINCT FROM o.conv_id
GROUP BY k.conv_id, k.n_common, k.tie
"""
