"""Collapse of cumulative conversation snapshots, and rendering of what remains.

A log that saves a conversation after each turn holds every prefix of it. A rolling
hash of the turns up to each turn identifies the prefixes: a conversation whose whole
hash is that of a proper prefix of another is dropped by an anti-join, and of equal
conversations that of the least id stays. Only then are turns rendered, one row each,
so that no conversation has to fit in one task. Everything is a DataFrame expression.

The rolling hash is the exclusive or of the hashes of (turn, content) up to a turn,
taken twice with different seeds. It is made in two levels, within runs of SPAN turn
numbers and over the runs, so that a conversation of any length is split.

Cases: a row whose conversation id or turn is null belongs to no conversation; a null
role or text counts as empty; rows that repeat a turn number form one turn, whose rows
are ordered by role and text; turn numbers are compared as they are, so snapshots
share a prefix only if they number its turns alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 256
#: Rendering of a turn by role; {role} is the role and {text} the text, with outer white space cut.
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn of a conversation, with two hashes of its number and content."""
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    content = [F.xxhash64(F.lit(seed), "role", "text") for seed in (11, 29)]
    # the count and the wrapped sum of halves keep repeated rows of a turn apart
    made = rows.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n"), *(F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(content)), *(F.sum(F.shiftright(h, 32)).alias(f"y{i}") for i, h in enumerate(content))
    )
    return made.select("conv_id", "turn", *(F.xxhash64(F.lit(i), "turn", "n", f"x{i}", f"y{i}").alias(f"h{i}") for i in range(2)))


def prefixes(each: DataFrame) -> DataFrame:
    """For each turn of a conversation the rolling hashes and count of the turns up to it, and whether it is the last."""
    each = each.withColumn("run", F.floor(F.col("turn") / SPAN))
    runs = each.groupBy("conv_id", "run").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("conv_id").orderBy(F.col("run").desc())
    runs = runs.select("conv_id", "run", *(F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"b{h}") for h in ("h0", "h1")), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bn"), (F.row_number().over(later) == 1).alias("last_run"))
    within = Window.partitionBy("conv_id", "run").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").desc())
    rolled = each.select("conv_id", "run", "turn", F.bit_xor("h0").over(within).alias("w0"), F.bit_xor("h1").over(within).alias("w1"), F.row_number().over(within.orderBy("turn")).alias("wn"), (F.row_number().over(back) == 1).alias("run_end"))
    return rolled.join(runs, ["conv_id", "run"]).select(
        "conv_id", "turn", F.col("w0").bitwiseXOR(F.col("bh0")).alias("p0"), F.col("w1").bitwiseXOR(F.col("bh1")).alias("p1"), (F.col("wn") + F.col("bn")).alias("n"), (F.col("last_run") & F.col("run_end")).alias("whole")
    )


def maximal(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations that no other extends or repeats: conv_id and n_turns."""
    each = prefixes(turns(df, conv_id, turn, role, text))
    key = ["p0", "p1", "n"]
    whole = each.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = each.where("not whole").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def rendered(role: Column, text: Column, template: str = TEMPLATE) -> Column:
    """A turn in the template."""
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), role, F.lit(between), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(after))


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rendered turns of the maximal conversations: conv_id, turn, n_turns, role, rendered."""
    kept = maximal(df, conv_id, turn, role, text)
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.where("turn is not null").join(kept, "conv_id").select("conv_id", "turn", "n_turns", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """The rendered turns of every maximal conversation."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
WITH r AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT conv_id, turn, list_sort(list([role, text])) AS content FROM r GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, list({'turn': turn, 'content': content}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT prefix, n, min(conv_id) AS conv_id FROM p WHERE len(prefix) = n GROUP BY prefix, n),
k AS (SELECT conv_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND len(p.prefix) < p.n))
SELECT r.conv_id, r.turn, CAST(k.n AS BIGINT) AS n_turns, r.role, '<|' || r.role || '|>' || chr(10) || regexp_replace(r.text, '^\s+|\s+$', '', 'g') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM r JOIN k ON r.conv_id = k.conv_id
"""
