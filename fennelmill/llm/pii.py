"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Matches of the fixed patterns are the seeds. The words before a seed are a lexical pattern; patterns and the instances
they stand before make a graph, over which scores are passed for some rounds: a pattern is as good as the share of its
instances that are known, an instance as good as the patterns that point at it on average. Patterns that are good enough
are promoted, what they point at and no worse pattern speaks against becomes known for the next round, and in the end is
what they found: identifiers that no fixed pattern describes.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, fresh_names, if_small, materialise
from fennelmill.llm.spans import add_matches, tagged, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns, each with a string that any match holds. They match what the contract's patterns match; repeated
#: groups are written as guarded single characters, so that long runs need neither recursion nor backtracking.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?+"
_IP = rf"^(?:{_PART}\.){{3}}{_PART}$"
#: An at sign written in brackets, with or without spaces around.
_AT = r"\x20?+[(\[{<]\x20?+(?i:at)\x20?+[)\]}>]\x20?+"
#: An address in words: three or more words of which the second is 'at' and the fourth, and any other even one, 'dot'.
_SPOKEN = r"[A-Za-z0-9_-]++(?i:\x20at\x20)[A-Za-z0-9_-]++(?:(?i:\x20dot\x20)[A-Za-z0-9_-]++)++"
#: Identifier-like tokens: a telephone number, grouped digits, an address in words, words joined by an at sign in
#: brackets, or a word with a digit or an at sign.
_TOKEN = rf"\+[0-9][ ().0-9-]+[0-9]|(?<!\S)(?:[0-9](?:(?![ -](?![0-9]))[0-9 -])++(?!\S)|{_SPOKEN}|[(\[{{<]*+[^\s@(\[{{<]++{_AT}[^\s@]\S*+|[^\s0-9@]*+[0-9@]\S*+)"
#: What a text with any token holds.
_ANY_TOKEN = r"[0-9@]|(?i:\x20dot\x20)|[(\[{<]\x20?(?i:at)\x20?[)\]}>]"
#: What makes a token an address behind an e-mail pattern, without any digit: an at sign between other characters.
_ADDRESS = rf"[^\s@]@[^\s@]|[^\s@]{_AT}[^\s@]|{_SPOKEN}"
#: Letters and digits, and digits among them, that a new identifier of each kind has at least; addresses need neither.
LEAST = {"email": (6, 3), "ip": (6, 3), "card": (6, 3), "phone": (6, 3)}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    reverse = F.reverse(_digits(value))
    digit = lambda i: F.substring(reverse, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(reverse)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": value.rlike(_IP), "card": F.when(n.between(12, 19), _luhn(value)).otherwise(False), "phone": n.between(9, 15)}[kind]


def _is_valid(kind: str, match: Column) -> Column:
    return _valid(kind, match["value"])


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add the array columns ``email``, ``ip``, ``card`` and ``phone`` of valid base matches."""
    for kind, (pattern, needs) in PATTERNS.items():
        df = add_matches(df, f"{kind}__any", text, pattern, needs=needs, holds=None if kind == "email" else "[0-9]")
        df = df.withColumn(kind, F.filter(f"{kind}__any", partial(_is_valid, kind))).drop(f"{kind}__any")
    return df


def _context(gap: Column) -> Column:
    """The last two words before a token, whole and in lower case; one or none at the beginning."""
    words = F.regexp_extract(F.reverse(gap), r"^\s*+(\S++(?:\s++\S++)?+)", 1)
    return F.lower(F.regexp_replace(F.reverse(words), r"\s+", " "))


def _kind_of(value: Column) -> Column:
    """The kind whose base pattern a token holds a valid match of."""
    email, ip, card, phone = (PATTERNS[k][0] for k in KINDS)
    return (
        F.when(value.rlike(email), "email")
        .when(value.startswith("+") & _valid("phone", value), "phone")
        .when(F.regexp_extract(value, ip, 0).rlike(_IP), "ip")
        .when(_valid("card", F.regexp_extract(value, card, 0)), "card")
    )


def bootstrap(occurrences: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, accepted: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Promoted patterns ``(context, kind, confidence, support)`` and known instances ``(value, kind, score)``, from ``(context, value, seed)``.

    ``seed`` is a kind or NULL. Edges are distinct pairs of a context and a value, so a value copied into many documents
    counts once for a context. A pattern's confidence in a kind is the weight of its known instances, divided by the
    number of all its instances plus one: a seed weighs 1, an instance that an earlier round accepted its score, any other
    nothing. A pattern with enough confidence and support is promoted; support is the number of its known instances, half
    of which have to be seeds. The score of an instance that is no seed is the mean confidence of all patterns that it
    occurs behind, promoted or not, weighted by the logarithm of their sizes; it is accepted if a promoted pattern points
    at it and its score reaches ``accepted``. So what stands behind many patterns of no confidence is never accepted, however many
    they are. Promotion knows no number but the thresholds. All groupings are sums, reduced map-side.
    """
    edges = materialise(occurrences.where("context != '' and value != ''").groupBy("context", "value").agg(F.max("seed").alias("seed")), "edges")
    known = patterns = None
    for turn in range(rounds):
        labelled = edges.join(known, "value", "left") if known is not None else edges.withColumns({"kind": F.lit(None).cast("string"), "score": F.lit(0.0)})
        weight = lambda k: F.when(F.col("seed") == k, 1.0).when(F.col("seed").isNull() & (F.col("kind") == k), F.col("score")).otherwise(0.0)
        seeds, learnt = (lambda k: F.count_if(F.col("seed") == k)), (lambda k: F.count_if(F.col("seed").isNull() & (F.col("kind") == k)))
        each = [F.struct((F.sum(weight(k)) / (F.count("*") + 1)).alias("confidence"), seeds(k).alias("seeds"), (seeds(k) + learnt(k)).alias("support"), F.lit(k).alias("kind")) for k in KINDS]
        scored = labelled.groupBy("context").agg(F.count("*").alias("n"), F.array_max(F.array(*each)).alias("best")).select("context", "n", "best.*")
        good = (F.col("confidence") >= confidence) & (F.col("support") >= support) & (2 * F.col("seeds") >= F.col("support"))
        before, patterns = patterns, materialise(scored.where("confidence > 0").withColumn("promoted", good), "patterns")
        size = F.log1p("n")
        pointed = edges.where("seed is null").join(patterns.where("promoted").select("context", F.col("kind").alias("of"), F.col("confidence").alias("c")), "context").groupBy("value").agg(F.max_by("of", F.struct("c", "of")).alias("kind"))
        sizes = edges.groupBy("context").agg(F.count("*").alias("n")).join(patterns.select("context", "kind", "confidence"), "context", "left").withColumnRenamed("kind", "of")
        around = edges.join(pointed, "value").join(sizes, "context")
        mean = F.sum(size * F.when(F.col("of") == F.col("kind"), F.col("confidence")).otherwise(0.0)) / F.sum(size)
        old, known = known, materialise(around.groupBy("value", "kind").agg(mean.alias("score")).where(F.col("score") >= accepted), "known")
        discard(*filter(None, (before, old)))
        if turn == 0 and known.isEmpty():
            break  # with nothing learnt every further round is the first again
    discard(edges)
    return patterns.where("promoted").select("context", "kind", "confidence", "support"), known


def find_personal_data(df: DataFrame, confidence: float = 0.8, support: int = 4, rounds: int = 3, accepted: float = 0.5, id_column: str = "doc_id", text_column: str = "text", least: dict[str, tuple[int, int]] = LEAST) -> DataFrame:
    """``(id, text_hash, base, found)`` for each row: tagged base spans and tagged spans that context found.

    Patterns with at least the given confidence and support find the identifier-like tokens they stand before, if those
    are accepted by :func:`bootstrap`; a token that overlaps a base span of its document is not found anew. Spans are in
    code points, the end exclusive.

    Bounds: a token is a telephone number, grouped digits, a word with a digit or an at sign, two words around an at
    sign in brackets, or an address in words ('jane at example dot com'). Behind an e-mail pattern a token with an at sign of
    any of these forms between other characters is found whatever else it holds; any other token needs ``least[kind]``: so many letters
    and digits, so many digits among them.

    Edge cases: a NULL or empty text has no spans; rows that repeat an id keep their own spans, as rows are told apart by
    id and text; a NULL id stays NULL; other columns are not read, whatever their names; an empty table gives no rows; a
    very long text is searched whole; values at the beginning of a text have no context and induce no pattern.
    """
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    spans = add_matches(base_spans(source, "text"), "token", "text", _TOKEN, gaps=True, holds=_ANY_TOKEN)
    base = F.concat(*(tagged(k, k, i) for i, k in enumerate(KINDS)))
    clean = lambda v: F.lower(F.regexp_replace(v, r"^[^A-Za-z0-9+@]++|[^A-Za-z0-9]++$", ""))
    tokens = F.transform("token", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("raw"), clean(m["value"]).alias("value"), _context(m["gap"]).alias("context"), _kind_of(m["value"]).alias("seed")))
    rows = materialise(spans.select("id", F.xxhash64("text").alias("text_hash"), base.alias("base"), tokens.alias("tokens")), "personal")
    occurrences = rows.select("id", "text_hash", F.explode("tokens").alias("t")).select("id", "text_hash", "t.*")
    patterns, known = bootstrap(occurrences, rounds, confidence, support, accepted)
    n, digits = F.length(F.regexp_replace("value", "[^a-z0-9]", "")), F.length(_digits(F.col("value")))
    likely = reduce(or_, ((F.col("kind") == k) & (n >= least[k][0]) & (digits >= least[k][1]) for k in KINDS), (F.col("kind") == "email") & F.col("value").rlike(_ADDRESS))
    lead = F.length(F.regexp_extract("raw", r"^[^A-Za-z0-9+@]*+", 0))
    trail = F.length(F.regexp_extract("raw", r"[^A-Za-z0-9]++$", 0))
    new = occurrences.where("seed is null").join(patterns.select("context", "kind"), "context").where(likely).join(known.select("value", "kind"), ["value", "kind"])
    new = new.select("id", "text_hash", (F.col("start") + lead).alias("start"), (F.col("end") - trail).alias("end"), "kind").distinct()
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    each = new.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("found"))
    joined = rows.join(materialise(each, "found"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    free = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return joined.select(F.col("id").alias(id_column), "text_hash", "base", F.coalesce(free, F.array().cast(rows.schema["base"].dataType)).alias("found"))


def _base_columns() -> list[Column]:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return [*map(count, KINDS), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256")]


def base_digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The digest columns of the base spans alone. A NULL or empty text has none, NULL and repeated ids stay, an empty table gives no rows."""
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    base = F.concat(*(tagged(k, k, i) for i, k in enumerate(KINDS)))
    return base_spans(source, "text").select(F.col("id").alias(id_column), base.alias("base")).select(id_column, *_base_columns())


def digests(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest columns of a :func:`find_personal_data` result, row by row: NULL and repeated ids stay, an empty table gives no rows."""
    return spans.select(id_column, *_base_columns(), written(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"))


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with every span of personal data replaced by its kind in brackets; ``n_chars``, if there, is set anew.

    Overlapping spans become one replacement, named by the first.

    Edge cases: a NULL text stays NULL, an empty one empty; rows with a NULL id are told apart by their texts; rows repeat
    as often as they came; all columns stay, whatever their names; an empty table gives no rows; a very long text is
    searched and redacted whole.
    """
    spans = find_personal_data(df, id_column=id_column, text_column=text_column)
    of_id, of_hash, places, own = fresh_names(df, "of_id", "of_hash", "spans", "hash")
    every = F.concat("base", "found")
    hit = spans.where(F.size("base") + F.size("found") > 0).select(F.col(id_column).alias(of_id), F.col("text_hash").alias(of_hash), F.array_sort(every).alias(places))
    hit = materialise(hit.dropDuplicates([of_id, of_hash]), "redactions")
    text = F.col(f"`{text_column}`")
    joined = df.withColumn(own, F.xxhash64(text.cast("string"))).join(if_small(hit, f"2 + 3 * size({places})"), F.col(f"`{id_column}`").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_hash)), "left")
    pieces = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))

    def merge(acc: Column, s: Column) -> Column:
        """Pieces that go, apart from each other: where they begin and end, and what stands there instead."""
        fresh = F.concat(acc["out"], F.array(F.struct(acc["to"].alias("after"), s["start"].alias("start"), s["mark"].alias("mark"))))
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(s["start"] >= acc["to"], fresh).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<struct<after:bigint,start:bigint,mark:string>>").alias("out"))
    part = lambda p: F.concat(F.substring(text, (p["after"] + 1).cast("int"), (p["start"] - p["after"]).cast("int")), p["mark"])
    done = F.aggregate(F.transform(places, pieces), begin, merge, lambda acc: F.concat(F.array_join(F.transform(acc["out"], part), ""), F.substring(text, (acc["to"] + 1).cast("int"), F.length(text))))
    out = joined.withColumn(text_column, F.when(F.col(places).isNotNull(), done).otherwise(text)).select(*(F.col(f"`{c}`") for c in df.columns))
    return out.withColumn("n_chars", F.when(F.col(f"`{text_column}`").isNotNull(), F.length(f"`{text_column}`")).otherwise(F.col("n_chars")).cast(out.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
