"""Secrets by fixed patterns, judged by who else holds them: corpus-wide ownership in DataFrame operations only.

Every candidate is reduced to a hash, and the hash is counted over distinct repositories and owners of the whole corpus.
What many of either hold is an example that was copied; what few hold and looks random is a live credential. On
that ground generic high-entropy strings, which no fixed pattern describes, are reported as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import materialise
from fennelmill.llm.spans import add_matches, tagged, written

KINDS = ("assign", "access", "hex")
#: The contract's patterns. The two latter hold their least length, which drops the same matches.
_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS, _HEX = r"AKIA[A-Z0-9]{14,}+", r"[0-9a-f]{16,}+"
#: Generic candidates: long runs with lower case, upper case and digits.
_GENERIC = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=.-])"
_MIXED = r"^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])(?=[^0-9]*+[0-9])"
_STAND_IN = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|12345678|abcdefgh|00000000|test"


def entropy(value: Column) -> Column:
    """Bits per character of a string, from the frequencies of its characters."""
    n = F.length(value)
    chars = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def looks_live(value: Column, bits: float) -> Column:
    """Whether a value is random enough and no stand-in."""
    return (entropy(value) >= bits) & ~value.rlike(_STAND_IN)


def find_secrets(df: DataFrame, owner: Column | str = "source", repository: Column | str | None = None, copied_from: int = 3, bits: float = 3.0, id_column: str = "doc_id", text_column: str = "text", copied_in: int = 5) -> DataFrame:
    """``(id, text_hash, base, found, n_live, n_copied)`` for each row.

    ``base`` holds the tagged spans of the fixed patterns, whatever their owners; ``found`` the spans of generic
    candidates that look live and are not copied. A candidate is copied if ``copied_from`` owners or more hold it, or
    ``copied_in`` repositories or more, be it of one owner. ``n_live`` and ``n_copied`` count the row's candidates of
    either sort that look live and are not copied, and those that are copied. The repository is the
    owner with the language unless given. Distinct owners are counted after a map-side distinct of (hash, repository,
    owner), so a secret that a third of all rows hold costs no task more than its repositories.

    Edge cases: a NULL or empty text has no spans; rows that repeat an id keep their own spans; a NULL owner counts as
    one owner of its own; other columns are not read, whatever their names; an empty table gives no rows; a very long
    text is searched whole.
    """
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = F.col(repository) if isinstance(repository, str) else repository
    if repository is None:
        repository = F.concat_ws("/", owner, F.col("lang")) if "lang" in df.columns else owner
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    rows = add_matches(rows, "assign", "text", _ASSIGN, group=2, needs=("=", ":"))
    rows = add_matches(rows, "access", "text", _ACCESS, needs="AKIA")
    rows = add_matches(add_matches(rows, "hex", "text", _HEX), "generic", "text", _GENERIC, holds="[0-9]")
    rows = rows.withColumn("assign", F.filter("assign", lambda m: F.length(m["part"]) >= 12)).withColumn("generic", F.filter("generic", lambda m: m["part"].rlike(_MIXED)))
    base = F.concat(*(tagged(k, k, i) for i, k in enumerate(KINDS)))
    judged = lambda k, i: F.transform(k, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("place"), m["end"].alias("end"), F.lit(k).alias("kind"), F.sha2(m["part"].cast("binary"), 256).alias("hash"), looks_live(m["part"], bits).alias("live")))
    candidates = F.concat(*(judged(k, i) for i, k in enumerate((*KINDS, "generic"))))
    rows = materialise(rows.select("id", F.xxhash64("text").alias("text_hash"), "owner", "repository", base.alias("base"), candidates.alias("candidates")), "secrets")
    each = rows.select("id", "text_hash", "owner", "repository", F.explode("candidates").alias("c")).select("id", "text_hash", "owner", "repository", "c.*")
    holders = each.select("hash", "repository", "owner").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owners = materialise(holders.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "owners")
    copied = (F.col("owners") >= copied_from) | (F.col("repositories") >= copied_in)
    judged_rows = each.join(owners, "hash").select("id", "text_hash", "start", "place", "end", "kind", (F.col("live") & ~copied).alias("live"), copied.alias("copied"))
    kept = judged_rows.where(F.col("live") | F.col("copied")).select("id", "text_hash", "start", "place", "end", "kind", "live", "copied", ((F.col("kind") == "generic") & F.col("live")).alias("new")).distinct()
    by_row = kept.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"), F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("start", "place", "end", "kind")))).alias("found")
    )
    joined = rows.join(materialise(by_row, "judged"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    zero = F.lit(0).cast("long")
    free = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return joined.select(F.col("id").alias(id_column), "text_hash", "base", F.coalesce(free, F.array().cast(rows.schema["base"].dataType)).alias("found"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def digests(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest columns of a :func:`find_secrets` result, row by row: NULL and repeated ids stay, an empty table gives no rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(id_column, *map(count, KINDS), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "found")).alias("spans"), "n_live", "n_copied")
