"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

Loggers often write a conversation again with every turn. The rolling hash of each turn prefix identifies a logged
conversation that is the beginning of a longer one; an anti-join of whole conversations against proper prefixes keeps
the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, if_small, materialise

#: Turns whose numbers share a block are numbered together, so a conversation of any length is dealt to many tasks.
BLOCK = 256
_MARK = ("x", "y")


def hashed(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(conv, turn, role, text, x, y)``: the turns, with 128 bits of hash of role and text; a NULL differs from an empty string."""
    rows = df.select(F.col(f"`{conv_column}`").alias("conv"), F.col(f"`{turn_column}`").cast("long").alias("turn"), F.col(f"`{role_column}`").cast("string").alias("role"), F.col(f"`{text_column}`").cast("string").alias("text"))
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return rows.where("conv is not null").select("*", mark(1).alias("x"), mark(2).alias("y"))


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv, block, place, x, y)``: distinct turns of :func:`hashed` with their place in the conversation, from 1, without their texts.

    Places run within blocks of turn numbers and are moved by the sizes of the blocks before; only block sizes are
    ordered by conversation. Roles and texts are read only where different turns of a conversation have equal numbers.
    """
    light = materialise(turns.groupBy("conv", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", *_MARK).agg(F.count("*").alias("rows")).drop("rows"), "turns")
    tied = materialise(light.groupBy("conv", "turn").agg(F.count("*").alias("n")).where("n > 1"), "ties").select(F.col("conv").alias("of_conv"), F.col("turn").alias("of_turn"))
    if tied.isEmpty():
        light = light.withColumn("among", F.lit(0))
    else:
        full = turns.join(if_small(tied), (F.col("conv") == F.col("of_conv")) & F.col("turn").eqNullSafe(F.col("of_turn"))).select("conv", "turn", "role", "text", *_MARK).distinct()
        ranked = full.withColumn("among", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")))
        ranked = ranked.select(F.col("conv").alias("of_conv"), F.col("turn").alias("of_turn"), F.col("x").alias("of_x"), F.col("y").alias("of_y"), "among")
        same = (F.col("conv") == F.col("of_conv")) & F.col("turn").eqNullSafe(F.col("of_turn")) & (F.col("x") == F.col("of_x")) & (F.col("y") == F.col("of_y"))
        light = light.join(ranked, same, "left").select("conv", "block", "turn", *_MARK, F.coalesce("among", F.lit(0)).alias("among"))
    sizes = light.groupBy("conv", "block").agg(F.count("*").alias("size"))
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("offset", upto).select(F.col("conv").alias("of_conv"), F.col("block").alias("of_block"), "offset")
    within = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "among"))
    placed = light.withColumn("within", within).join(offsets, (F.col("conv") == F.col("of_conv")) & F.col("block").eqNullSafe(F.col("of_block")))
    return placed.select("conv", "block", (F.col("within") + F.col("offset")).alias("place"), *_MARK)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv, place, n, x, y)``: the 128-bit rolling hash of each prefix, and the conversation's length."""
    keyed = turns.select("conv", "block", "place", F.xxhash64(F.lit(3), "place", *_MARK).alias("x"), F.xxhash64(F.lit(4), "place", *_MARK).alias("y"))
    blocks = keyed.groupBy("conv", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.max("place").alias("to"))
    by_conv = Window.partitionBy("conv").orderBy("to")
    before = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("of_conv"), F.col("block").alias("of_block"), *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("bx", "by")), F.max("to").over(Window.partitionBy("conv")).alias("n"))
    rolling = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = keyed.withColumns({c: F.bit_xor(c).over(rolling) for c in _MARK})
    joined = rolled.join(blocks, (F.col("conv") == F.col("of_conv")) & F.col("block").eqNullSafe(F.col("of_block")))
    return joined.select("conv", "place", "n", F.col("x").bitwiseXOR(F.col("bx")).alias("x"), F.col("y").bitwiseXOR(F.col("by")).alias("y"))


def collapse(prefixes: DataFrame) -> DataFrame:
    """``(conv, n, copies)`` of the maximal conversations; of equal ones the smallest id, with their number."""
    whole = prefixes.where("place = n").groupBy("n", "x", "y").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    proper = prefixes.where("place < n").select(F.col("place").alias("n"), "x", "y").distinct()
    return whole.join(proper, ["n", "x", "y"], "left_anti").select("conv", "n", "copies")


def format_chats(df: DataFrame, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n", conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(conv_id, n_turns, n_copies, rendered)`` of each maximal conversation.

    ``rendered`` joins the turns in order, each as the opening with its role, its text and the closing. ``n_copies``
    counts the equal logs of the conversation. Snapshots are found by hashes alone: texts are shuffled once, and only those
    of conversations that stay. A conversation becomes one row, as its rendered text is one value; nothing else gathers a
    conversation in a task.

    Edge cases: rows without a conversation id belong to none and are left out; turns that repeat in full are one turn;
    turns with equal numbers come in order of role and text, those without a number first; a NULL role or text renders
    as empty but differs from an empty one when prefixes are compared; other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    turns = hashed(df, conv_column, turn_column, role_column, text_column)
    places = materialise(numbered(turns), "places")
    prefixes = materialise(prefix_hashes(places), "prefixes")
    kept = materialise(collapse(prefixes), "maximal")
    discard(places, prefixes)
    head, tail = opening.split("{role}")
    stay = turns.select("conv", "turn", "role", "text").join(if_small(kept), "conv")
    logs = stay.groupBy("conv", "n", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    piece = lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("")), F.lit(tail), F.coalesce(t["text"], F.lit("")), F.lit(closing))
    return logs.select(F.col("conv").alias(conv_column), F.col("n").cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), F.array_join(F.transform("turns", piece), "").alias("rendered"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS s,
             string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
      FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, s, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY s)
SELECT a.conv_id, CAST(len(a.s) AS BIGINT) AS n_turns, a.n_copies, a.rendered
FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.s[1] IS NOT DISTINCT FROM a.s[1] AND len(b.s) > len(a.s) AND b.s[1:len(a.s)] = a.s)
"""
