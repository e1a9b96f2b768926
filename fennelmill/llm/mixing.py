"""Mixing sources by temperature, in DataFrame operations only.

A source's weight is its token share raised to an exponent, normalised. The exponent is the one nearest to 1 (the
natural mixture) at which the weights reach a target entropy, raised where a source would else repeat beyond a limit; it
is found by bisection in many parts at once. Sources may be given weights outright. The token budget is the caller's, or
the smallest at which no source is cut below one pass, so that weights are met by repeating, and no document is lost.

Each pass over a source is a permutation of blocks, and the last pass stops where the source's budget does: inside one
block, by a permutation of its sub-blocks, inside one of those by a permutation of its documents, and where copies of one
document lie there between two of them. Only sums over blocks are ordered and accumulated, so a source with a third of
all rows is no larger a group than any other, and copies are summed before they are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, fresh_names, materialise, words_count

#: Blocks of a source, and sub-blocks of a block.
BLOCKS = 128
#: Parts into which one step of the bisection cuts the interval, and the width at which it ends.
_PARTS, _WIDTH = 16, 1e-9


def find_exponent(tokens: DataFrame, entropy_share: float, repeat_limit: float, budget: int | None = None) -> float:
    """The largest exponent in [0, 1] whose weights have ``entropy_share`` of the greatest entropy, or a larger one that keeps repetition within the limit.

    Entropy and repetition both fall as the exponent rises; repetition is what the budget asks of the smallest source, or
    without a budget what the smallest source repeats while the largest has one pass. Each step evaluates some exponents
    in one grouped sum over the sources, of which the driver gets one row each.
    """
    total, largest, n = tokens.where("tokens > 0").agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()
    if not total or n < 2:
        return 1.0
    shares = tokens.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"))
    aim, most = entropy_share * math.log(n), largest / total

    def good(z: float, e: float, r: float, a: float) -> tuple[bool, bool]:
        passes = budget / total * r / z if budget else r / most ** (a - 1)
        return math.log(z) - a * e / z >= aim, passes <= repeat_limit

    def last(which: int, holds_below: bool) -> float:
        """The end of the part of [0, 1] in which a condition holds: below it, or above it."""
        low, high = 0.0, 1.0
        while high - low > _WIDTH:
            grid = [low + (high - low) * i / _PARTS for i in range(_PARTS + 1)]
            power = F.pow("p", F.col("a"))
            seen = shares.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("e"), F.max(F.pow("p", F.col("a") - 1)).alias("r"))
            held = {r.a: good(r.z, r.e, r.r, r.a)[which] for r in seen.collect()}
            inside = [a for a in grid if held[a] == holds_below]
            if not inside:
                return low
            edge = max(inside)
            if edge == high:
                return high
            low, high = edge, grid[grid.index(edge) + 1]
        return low if holds_below else high

    return round(max(last(0, True), last(1, False)), 9)


def source_repeats(tokens: DataFrame, entropy_share: float, repeat_limit: float, budget: int | None = None, targets: dict[str | None, float] | None = None) -> DataFrame:
    """``(skey, all_tokens, weight, exponent, repeats)`` of ``(skey, tokens)``: how often each source is passed over, to nine digits.

    Sources in ``targets`` get the weights given there, the others share what is left of 1 by temperature. A source
    without tokens has weight 0 and one pass.
    """
    given = {("n" if k is None else f"s{k}"): w for k, w in (targets or {}).items()}
    fixed = F.lit(None).cast("double")
    for k, w in given.items():
        fixed = F.when(F.col("skey") == k, F.lit(float(w))).otherwise(fixed)
    marked = tokens.select("skey", F.col("tokens").alias("all_tokens"), F.when(F.col("tokens") > 0, fixed).alias("fixed"))
    free = marked.where("fixed is null").select("skey", F.col("all_tokens").alias("tokens"))
    a = find_exponent(free, entropy_share, repeat_limit, budget)
    left, total = 1.0 - (marked.agg(F.sum("fixed")).first()[0] or 0.0), free.agg(F.sum("tokens")).first()[0] or 1
    if left < -1e-9:
        raise ValueError("the weights given to sources exceed 1")
    powered = F.when((F.col("all_tokens") > 0) & F.col("fixed").isNull(), F.pow(F.col("all_tokens") / F.lit(total), F.lit(a))).otherwise(0.0)
    norm = marked.agg(F.sum(powered)).first()[0] or 1.0
    weighed = marked.withColumn("weight", F.coalesce("fixed", F.lit(max(0.0, left)) * powered / F.lit(norm)))
    some = (F.col("all_tokens") > 0) & (F.col("weight") > 0)
    amount = budget or weighed.where(some).agg(F.max(F.col("all_tokens") / F.col("weight"))).first()[0] or 1.0
    exact = F.round(F.lit(float(amount)) * F.col("weight") / F.col("all_tokens"), 9)
    exact = F.when(F.abs(exact - F.round(exact)) < 1e-6, F.round(exact)).otherwise(exact)  # a limit that binds is met, however the exponent is rounded
    repeats = F.when(some, exact).when(F.col("all_tokens") > 0, 0.0).otherwise(1.0)
    return weighed.select("skey", "all_tokens", "weight", F.lit(a).alias("exponent"), repeats.alias("repeats"))


def prepared(df: DataFrame, names: dict[str, str], id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``df`` with the source's key and the block keys of each row, made of its id and text, in columns of the given names."""
    source = F.col(f"`{source_column}`").cast("string")
    key = F.xxhash64(F.col(f"`{id_column}`").isNull(), F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string"))
    spread = lambda seed: F.pmod(F.xxhash64(names["key"], F.lit(seed)), F.lit(BLOCKS)).cast("int")
    skey = F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))
    return df.withColumn(names["key"], key).withColumn(names["skey"], skey).withColumn(names["block"], spread(1)).withColumn(names["part"], spread(2))


def plan(docs: DataFrame, entropy_share: float, repeat_limit: float, budget: int | None = None, targets: dict[str | None, float] | None = None) -> DataFrame:
    """What becomes of each block of each source, from ``(skey, tokens, key, block, part)``.

    Returns ``(skey, block, weight, exponent, passes, slots, whole, parts, cut_part, cut_key, cut_copies)``: how many full passes a
    block is in; where it stands in each pass, the partial one last, as a fraction of the source's stream; whether the partial
    pass holds it whole; and for the block in which the budget ends, the sub-blocks held whole, the one held in part, the
    first key of that which is not held whole, and how many of its copies are.
    """
    parts = materialise(docs.groupBy("skey", "block", "part").agg(F.sum("tokens").alias("tokens")), "parts")
    blocks = materialise(parts.groupBy("skey", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    tokens = materialise(blocks.groupBy("skey").agg(F.sum("tokens").alias("tokens")), "sources")
    aims = source_repeats(tokens, entropy_share, repeat_limit, budget, targets)
    aims = aims.withColumn("passes", F.floor("repeats").cast("int")).withColumn("budget", F.floor((F.col("repeats") - F.col("passes")) * F.col("all_tokens")).cast("long"))
    each = blocks.select("skey", "block", "tokens").join(aims, "skey").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    before = Window.partitionBy("skey", "pass").orderBy(F.xxhash64("skey", "pass", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("upto", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    stream = F.col("repeats") * F.col("all_tokens")
    slot = F.when(stream > 0, (F.col("pass") * F.col("all_tokens") + F.col("upto")) / stream).otherwise(0.0)
    partial = F.col("pass") == F.col("passes")
    each = each.withColumn("slot", slot).withColumn("whole", partial & (F.col("budget") > 0) & (F.col("upto") + F.col("tokens") <= F.col("budget"))).withColumn("left", F.when(partial & (F.col("upto") < F.col("budget")) & ~F.col("whole"), F.col("budget") - F.col("upto")))
    by_block = materialise(
        each.groupBy("skey", "block").agg(
            F.max("weight").alias("weight"), F.max("exponent").alias("exponent"), F.max("passes").alias("passes"), F.transform(F.array_sort(F.collect_list(F.struct("pass", "slot"))), lambda s: s["slot"]).alias("slots"), F.bool_or("whole").alias("whole"), F.max("left").alias("left")
        ),
        "blocks",
    )
    cut = by_block.where("left is not null").select("skey", "block", "left")
    inside = Window.partitionBy("skey", "block").orderBy(F.xxhash64("skey", "part"), "part").rowsBetween(Window.unboundedPreceding, -1)
    sub = parts.select("skey", "block", "part", "tokens").join(cut, ["skey", "block"]).withColumn("upto", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    sub = sub.withColumn("whole", F.col("upto") + F.col("tokens") <= F.col("left")).withColumn("rest", F.when(~F.col("whole") & (F.col("upto") < F.col("left")), F.col("left") - F.col("upto")))
    cuts = materialise(sub.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("part")))).alias("parts"), F.max(F.when(F.col("rest").isNotNull(), F.struct("part", "rest"))).alias("cut")), "cuts")
    ends = cuts.where("cut is not null").select("skey", "block", F.col("cut.part").alias("part"), F.col("cut.rest").alias("rest"))
    at = Window.partitionBy("skey", "block", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = docs.select("skey", "block", "part", "tokens", "key").join(ends, ["skey", "block", "part"]).groupBy("skey", "block", "part", "key").agg(F.max("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("rest").alias("rest"))
    keys = keys.withColumn("upto", F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(at), F.lit(0))).where("upto + tokens * copies > rest")
    held = F.greatest(F.lit(0).cast("long"), F.expr("(rest - upto) div tokens"))
    last = keys.groupBy("skey", "block").agg(F.min(F.struct("key", held.alias("copies"))).alias("last"))
    joined = by_block.join(cuts, ["skey", "block"], "left").join(last, ["skey", "block"], "left")
    out = materialise(joined.select("skey", "block", "weight", "exponent", "passes", "slots", "whole", "parts", F.col("cut.part").alias("cut_part"), F.col("last.key").alias("cut_key"), F.col("last.copies").alias("cut_copies")), "mixture")
    discard(parts, blocks, tokens, by_block, cuts)
    return out


_PLANNED = ("weight", "exponent", "passes", "slots", "whole", "parts", "cut_part", "cut_key", "cut_copies")
#: What :func:`mix` adds to a table's columns.
ADDED = ("mix_pass", "mix_slot", "mix_order", "mix_weight", "mix_exponent")


def mix(df: DataFrame, entropy_share: float = 0.92, repeat_limit: float = 2.0, budget: int | None = None, targets: dict[str | None, float] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as its source's weight asks, with ``mix_pass``, ``mix_slot``, ``mix_order``, ``mix_weight`` and ``mix_exponent``.

    Ordered by ``mix_slot`` and ``mix_order`` the rows are the mixed stream: a source's blocks are spread evenly over
    it, so any stretch holds sources by weight. Tokens are words; the realised tokens of a source fall short of its
    budget by less than one document. ``budget`` is the number of tokens of the whole stream; ``targets`` are weights of
    sources (None for the NULL source), the others sharing the rest by temperature.

    Edge cases: a NULL source is a source; sources without tokens keep one pass at weight 0; a NULL text has no tokens
    and stays; a NULL id is allowed; rows of equal id and text are told apart only where the budget ends between them;
    with a budget below the table's tokens documents are left out, without one never; a very long document counts whole;
    an empty table gives no rows; columns of the input that have the added names are replaced, all others stay.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in ADDED))
    wanted = ("key", "skey", "block", "part", *_PLANNED, "again", "number", "shift", "of_skey", "of_place", "place", "at")
    names = dict(zip(wanted, fresh_names(df, *wanted)))
    named = prepared(df, names, id_column, text_column, source_column)
    light = materialise(named.select(*(F.col(names[c]).alias(c) for c in ("skey", "key", "block", "part")), words_count(F.col(f"`{text_column}`").cast("string")).alias("tokens")), "lengths")
    plans = plan(light, entropy_share, repeat_limit, budget, targets)
    discard(light)
    of = plans.select(F.col("skey").alias(names["skey"]), F.col("block").alias(names["block"]), *(F.col(c).alias(names[c]) for c in _PLANNED))
    joined = named.join(of, [names["skey"], names["block"]])
    return _expanded(joined, plans, names, df.columns)


def _expanded(joined: DataFrame, plans: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """One row for each pass that holds a row."""
    c = {k: F.col(v) for k, v in names.items()}
    in_cut = F.coalesce(c["part"] == c["cut_part"], F.lit(False))
    again: Column = F.coalesce(c["whole"], F.lit(False)) | F.coalesce(F.array_contains(c["parts"], c["part"]), F.lit(False)) | (in_cut & (c["key"] < c["cut_key"]))
    rows = joined.withColumn(names["again"], again)
    if not plans.where("cut_copies > 0").isEmpty():
        between = in_cut & (c["key"] == c["cut_key"]) & (c["cut_copies"] > 0)
        rows = rows.where(~between).unionByName(_numbered(joined.where(between), names).drop(names["number"]))
    passes = c["passes"] + c["again"].cast("int")
    out = rows.where(passes > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    out = out.withColumn("mix_slot", F.get(c["slots"], F.col("mix_pass"))).withColumn("mix_order", F.xxhash64(c["key"], "mix_pass")).withColumn("mix_weight", c["weight"]).withColumn("mix_exponent", c["exponent"])
    return out.select(*(F.col(f"`{x}`") for x in columns), *ADDED)


def _numbered(copies: DataFrame, names: dict[str, str]) -> DataFrame:
    """Copies of the documents at which budgets end, numbered by source: within the pieces of a written table, which then follow each other."""
    skey, place, at, of_skey, of_place = (names[x] for x in ("skey", "place", "at", "of_skey", "of_place"))
    rows = materialise(copies.withColumn(place, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "copies")
    sizes = rows.groupBy(F.col(skey).alias(of_skey), F.col(place).alias(of_place)).agg(F.count("*").alias(names["shift"]))
    sizes = sizes.withColumn(names["shift"], F.coalesce(F.sum(names["shift"]).over(Window.partitionBy(of_skey).orderBy(of_place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = rows.withColumn(names["number"], F.row_number().over(Window.partitionBy(skey, place).orderBy(at)))
    joined = within.join(sizes, (F.col(skey) == F.col(of_skey)) & (F.col(place) == F.col(of_place))).withColumn(names["again"], F.col(names["number"]) + F.col(names["shift"]) <= F.col(names["cut_copies"]))
    return joined.drop(place, at, of_skey, of_place, names["shift"])


def summary(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixed stream without its texts: id, source and place of each row. NULLs, empty tables and the like as in :func:`mix`."""
    counted = df.select(F.col(f"`{id_column}`"), F.col(f"`{source_column}`"), F.col(f"`{text_column}`"))
    mixed = mix(counted, id_column=id_column, text_column=text_column, source_column=source_column, **options)
    return mixed.drop(text_column)
