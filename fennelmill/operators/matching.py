"""Best match by shared tokens, as equi-joins on rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.functions import scalars as S
from fennelmill.operators.relational import spread
from fennelmill.sources.files import written

#: Rarest tokens of a left row that are tried first, for a score that others have to reach.
FIRST = 2
#: Bytes of left tokens that may be sent to every executor. More are shuffled instead.
MOST_BROADCAST = 16 << 20
#: Rows of a join on tokens that a task counts by pairs.
JOINED = 2_000_000


def best_match(left: DataFrame, pool: DataFrame, left_key: str, left_text: str, pool_key: str, pool_text: str, pool_order: str | None = None, least: int = 2) -> DataFrame:
    """``(left_key, match, score)``: for each left row the pool row that shares most distinct tokens with it.

    Ties go to the earliest pool row; a score under ``least`` is no match, and every left row is returned.
    """
    found = best_matches(left, pool, left_key, left_text, pool_key, pool_text, pool_order, least, 1).drop("place")
    return left.select(left_key).join(found, left_key, "left")


def best_matches(left: DataFrame, pool: DataFrame, left_key: str, left_text: str, pool_key: str, pool_text: str, pool_order: str | None = None, least: int = 2, most: int = 3) -> DataFrame:
    """``(left_key, place, match, score)``: for each left row the ``most`` pool rows that share most distinct tokens with it, ``least`` or more; places count from 1.

    Ties go to the earlier pool row. The search is bounded and exact: a left row's tokens are ordered from the rarest in
    the pool to the most frequent. The pool rows that hold one of its two rarest tokens give a score ``s`` that ``most`` rows
    reach already. Any row that reaches ``s`` too holds one of the ``n - s + 1`` rarest of the ``n`` tokens, so only rows that
    do are scored beside them; a frequent token brings rows together only where nothing better is known. Of the pool's tokens
    only those go on that a left row has; they get numbers, are gathered by one shuffle and written once. While the left rows are small
    enough to be broadcast, pool rows are scored where they are read, each pair at the rarest token that both hold.
    """
    rows = spread(pool.select(F.struct(F.col(pool_order or pool_key).alias("o"), F.col(pool_key).alias("r")).alias("at"), F.col(pool_text).alias("text")), 1)
    named = written(left.select(F.col(left_key).alias("l"), F.explode(S.token_set(left_text)).alias("name")).distinct(), "asked")
    small = (named.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0) <= MOST_BROADCAST
    sent = F.broadcast if small else lambda df: df
    numbers = written(named.select("name").distinct().withColumn("token", F.monotonically_increasing_id()), "numbers")
    a = named.join(numbers, "name").select("l", "token")
    each = rows.select("at", F.explode(S.token_set("text")).alias("name")).join(sent(numbers), "name").select("at", "token")
    pool_tokens = written(each.groupBy("at").agg(F.collect_set("token").alias("tokens")).where(F.size("tokens") >= least), "pool")
    each = pool_tokens.select("*", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("f"))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"])
    ranked = written(a.join(held, "token").groupBy("l").agg(rarest.alias("own")).where(F.size("own") >= least), "ranked")
    kind = pool.schema[pool_key].dataType
    if ranked.isEmpty():  # no left row has enough tokens in the pool
        return left.select(left_key, F.lit(None).cast("int").alias("place"), F.lit(None).cast(kind).alias("match"), F.lit(None).cast("long").alias("score")).limit(0)
    first_in_order = Window.partitionBy("l").orderBy("best")

    def scored(wanted: DataFrame) -> DataFrame:
        """``(l, best)``: the negated score and place of the best pool rows of each left row among those that hold a wanted token and none rarer."""
        if small:
            pairs = each.join(F.broadcast(wanted), "token").join(F.broadcast(ranked), "l")
        else:
            rarest_held = wanted.join(each.select("at", "token"), "token").select("l", "at", "token")
            pairs = rarest_held.join(ranked, "l").join(pool_tokens, "at")
        both = pairs.select("l", "token", "at", F.array_intersect("own", "tokens").alias("shared")).where(F.get("shared", F.lit(0)) == F.col("token"))
        return best_of(both.select("l", F.struct((-F.size("shared")).alias("s"), "at").alias("best")).where(F.col("best.s") <= -least))

    def best_of(both: DataFrame) -> DataFrame:
        if most == 1:
            return both.groupBy("l").agg(F.min("best").alias("best"))
        return both.withColumn("n", F.row_number().over(first_in_order)).where(F.col("n") <= most).drop("n")

    first = written(scored(ranked.select("l", F.explode(F.slice("own", 1, FIRST)).alias("token"))), "first")
    reached = first.groupBy("l").agg(F.when(F.count("*") == most, -F.max("best.s")).alias("s"))
    upto = F.size("own") - F.coalesce("s", F.lit(least)) + 1
    more = ranked.join(reached, "l", "left").select("l", F.explode(F.slice("own", F.lit(FIRST + 1), F.greatest(upto - FIRST, F.lit(0)))).alias("token"))
    best = best_of(first.union(scored(more)))
    return best.select(F.col("l").alias(left_key), F.row_number().over(first_in_order).alias("place"), F.col("best.at.r").alias("match"), (-F.col("best.s")).cast("long").alias("score"))


def overlaps(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str) -> DataFrame:
    """``(left_key, right_key, shared)``: the number of distinct tokens that the texts of two rows share, if any.

    All rows of both sides meet by an equi-join on tokens, so the result has as many rows as pairs share a token. Keys
    have to be unique. The rows that the join makes are counted by tokens first, and the right rows are dealt to as many tasks as
    keep each below ``JOINED`` of them, where pairs are counted without another shuffle; so the memory of a task has a bound.
    """
    named = written(left.select(left_key, F.explode(S.token_set(left_text)).alias("name")), "asked")
    small = (named.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0) <= MOST_BROADCAST
    sent = F.broadcast if small else lambda df: df
    numbers = written(named.groupBy("name").agg(F.count("*").alias("f")).withColumn("token", F.monotonically_increasing_id()), "numbers")
    a = named.join(numbers, "name").select(left_key, "token")
    b = written(spread(right.select(right_key, right_text), 1).select(right_key, F.explode(S.token_set(right_text)).alias("name")).join(sent(numbers), "name").select(right_key, "token", "f"), "held")
    joined = b.agg(F.sum("f")).first()[0] or 0
    pieces = max(b.sparkSession.sparkContext.defaultParallelism, -(-joined // JOINED))
    if small:
        pairs = b.select(right_key, "token").repartition(pieces, right_key).join(F.broadcast(a), "token")
    else:
        pairs = a.join(b.select(right_key, "token"), "token").select(left_key, right_key).repartition(pieces, left_key, right_key)
    return pairs.groupBy(left_key, right_key).agg(F.count("*").cast("int").alias("shared"))


def fuzzy_search(df: DataFrame, query: str, columns: list[str], threshold: float = 0.4, least: int = 2) -> DataFrame:
    """Rows whose best column is close to the query, with ``distance`` from 0 to 1 (an extension).

    Case is ignored. Where a column holds the query it is at distance 0; else the distance is the smallest normalised
    edit distance of one of its words, compared only where lengths allow it within the threshold.
    """
    q = query.lower()
    n = len(q)

    def distance(c: str) -> F.Column:
        text = F.lower(S.text(c))
        words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= least) & (F.abs(F.length(w) - n) <= F.lit(threshold) * F.greatest(F.length(w), F.lit(n))))
        near = F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(q)) / F.greatest(F.length(w), F.lit(n))))
        return F.when(F.contains(text, F.lit(q)), 0.0).otherwise(F.coalesce(near, F.lit(1.0)))

    each = [distance(c) for c in columns]
    return df.withColumn("distance", F.least(*each) if len(each) > 1 else each[0]).where(F.col("distance") <= threshold)


#: Characters of a pattern that are matched at once, the least score of a match, and the score of an equal text.
CHUNK, LEAST_SCORE, EQUAL_SCORE = 32, 0.001, 2.220446049250313e-16
#: Longest pieces of a pattern that are looked up in the index.
_GRAM = 3


def _letter(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _masks(pattern: Column, m: Column) -> Column:
    """For each letter of a pattern, read from its end, the bits of its places."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    letters = F.transform(F.sequence(F.lit(1), m), lambda i: _letter(pattern, i))
    bit = lambda i: F.call_function("shiftleft", one, m - i)
    bits = lambda c: F.aggregate(F.sequence(F.lit(1), m), zero, lambda held, i: held.bitwiseOR(F.when(F.get(letters, i - 1) == c, bit(i)).otherwise(zero)))
    return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, bits(c))))


def _start_scores(text: str, size: str, masks: str, m: str, at: str, distance: int) -> Column:
    """The least ``errors / m + |start - at| / distance`` of a pattern (1 to ``CHUNK`` characters) over all places of the text where a match starts.

    Both are read from their ends, so that the column of edit distances at a place is the least number of errors of a
    match that starts there; the column is kept as two words of differences, one bit a character of the pattern.
    """
    m, at, zero = F.col(m), F.col(at), F.lit(0).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), m) - 1
    top = F.call_function("shiftleft", F.lit(1).cast("long"), m - 1)

    def step(s: Column, i: Column) -> Column:
        pv, mv = s["pv"], s["mv"]
        x = F.coalesce(F.try_element_at(F.col(masks), _letter(F.col(text), i)), zero).bitwiseOR(mv)
        d0 = (x.bitwiseAND(pv) + pv).bitwiseXOR(pv).bitwiseOR(x)
        less, more = pv.bitwiseAND(d0), mv.bitwiseOR(F.bitwise_not(pv.bitwiseOR(d0)).bitwiseAND(full))
        errors = s["errors"] + F.when(more.bitwiseAND(top) != 0, 1).otherwise(0) - F.when(less.bitwiseAND(top) != 0, 1).otherwise(0)
        more, less = F.shiftleft(more, 1).bitwiseAND(full), F.shiftleft(less, 1).bitwiseAND(full)
        best = F.least(s["best"], errors / m + F.abs(i - 1 - at) / F.lit(distance))
        return F.struct(less.bitwiseOR(F.bitwise_not(more.bitwiseOR(d0)).bitwiseAND(full)).alias("pv"), more.bitwiseAND(d0).alias("mv"), errors.cast("int").alias("errors"), best.cast("double").alias("best"))

    start = F.struct(full.alias("pv"), zero.alias("mv"), m.cast("int").alias("errors"), F.lit(float("inf")).alias("best"))
    return F.aggregate(F.filter(F.sequence(F.col(size), F.lit(0), F.lit(-1)), lambda i: i > 0), start, step, lambda s: s["best"])


def search(df: DataFrame, queries: DataFrame, key: str, query: str, weights: dict[str, float], threshold: float = 0.4, location: int = 0, distance: int = 1000) -> DataFrame:
    """``(key, query, score)`` of all rows and queries that match, 0 is best; case is ignored.

    A query matches a text where it starts ``x`` characters in with so few errors (letters missing, added or replaced) that
    ``errors / length + |x - location| / distance`` is at most the threshold. Queries longer than ``CHUNK`` are cut, and the mean over
    chunks counts, 1 for one that does not match. A row matches by any of its columns: the score is the product
    of the columns' scores, each to the power of its share of the weights over the root of its number of words.

    Of ``k + 1`` pieces of a pattern with at most ``k`` errors one is there unchanged, at most ``k`` places off. So pairs of
    distinct texts and patterns come from an equi-join of pieces with an index of short grams and their places, and only
    those are compared. Texts matter as far as the distance lets them. NULL and empty texts and queries match nothing;
    repeated queries count once.
    """
    reach = int(threshold * distance + 1e-9)
    shares = {c: w / sum(weights.values()) for c, w in weights.items()}
    asked = queries.select(F.lower(F.col(query).cast("string")).alias("q")).where("q <> ''").distinct()
    number = F.ceil(F.length("q") / CHUNK).cast("int")
    start = F.when(F.col("i") < F.col("chunks") - 1, F.col("i") * CHUNK).otherwise(F.greatest(F.lit(0), F.length("q") - CHUNK))
    chunks = asked.withColumn("chunks", number).withColumn("i", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("at", start)
    chunks = chunks.withColumn("pattern", F.expr(f"substring(q, at + 1, {CHUNK})")).withColumn("m", F.length("pattern")).withColumn("k", F.least(F.col("m") - 1, F.floor(F.lit(threshold + 1e-9) * F.col("m")).cast("int")))
    chunks = written(chunks.withColumn("at", F.col("at") + F.lit(location)), "patterns")
    farthest = (chunks.agg(F.max("at")).first()[0] or 0) + reach + 2 * CHUNK
    # rows with the same texts have the same scores, so distinct rows of texts are scored, and rows get theirs by one join
    low = [f"text{n}" for n in range(len(shares))]
    rows = df.select(F.col(key).alias("row"), *(F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).alias(n) for c, n in zip(shares, low)))
    held = written(rows.select(*low).distinct().withColumn("held", F.monotonically_increasing_id()), "held")
    each = held.select("held", F.explode(F.array(*(F.struct(F.col(n).alias("text"), F.lit(float(s)).alias("share")) for n, s in zip(low, shares.values())))).alias("c")).select("held", "c.*").where("text <> ''")
    texts = written(each.select("text").distinct().select(F.monotonically_increasing_id().alias("tid"), "text", F.expr(f"substring(text, 1, {farthest})").alias("near")).withColumn("size", F.length("near")), "texts")
    # the pieces of a pattern, and the grams of the lengths that they have
    width = (F.col("m") / (F.col("k") + 1)).cast("int")
    pieces = chunks.select("pattern", "at", "m", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), lambda j: F.struct((j * width).alias("offset"), F.least(F.lit(_GRAM), width).alias("n")))).alias("p")).select("pattern", "at", "k", "p.offset", F.expr("substring(pattern, p.offset + 1, p.n)").alias("gram")).distinct()
    lengths = [r.n for r in pieces.select(F.length("gram").alias("n")).distinct().collect()]

    def of_length(n: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda x: x + n <= F.col("size"))
        return F.transform(places, lambda x: F.struct(x.alias("place"), F.substring(F.col("near"), x + 1, F.lit(n)).alias("gram")))

    grams = F.concat(*map(of_length, lengths)) if lengths else F.expr("cast(array() as array<struct<place: int, gram: string>>)")
    index = texts.select("tid", F.explode(grams).alias("g")).select("tid", "g.*")
    fits = f"abs(place - offset - at) <= {reach} + k"
    pairs = pieces.join(index, "gram").where(fits).select("tid", "pattern", "at").distinct()
    patterns = written(chunks.select("pattern", "at", "m").distinct().withColumn("masks", _masks(F.col("pattern"), F.col("m"))), "masks")
    compared = pairs.join(texts, "tid").join(patterns, ["pattern", "at"]).withColumn("score", _start_scores("near", "size", "masks", "m", "at", distance)).where(F.col("score") <= threshold + 1e-12)
    scored = chunks.join(compared.select("tid", "text", "pattern", "at", "score"), ["pattern", "at"]).groupBy("tid", "text", "q", "chunks").agg(F.sum(F.greatest(F.lit(LEAST_SCORE), F.col("score"))).alias("sum"), F.count("*").alias("n"))
    found = scored.select("text", "q", F.when(F.col("text") == F.col("q"), EQUAL_SCORE).otherwise((F.col("sum") + F.col("chunks") - F.col("n")) / F.col("chunks")).alias("score"))
    norm = F.round(1 / F.sqrt(F.greatest(F.lit(1), F.regexp_count("text", F.lit("[^ ]+")))), 3)
    scores = written(each.join(found, "text").groupBy("held", "q").agg(F.exp(F.sum(F.log("score") * F.col("share") * norm)).alias("score")), "scores")
    return rows.join(held, low).join(scores, "held").select(F.col("row").alias(key), F.col("q").alias(query), "score")
