"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fennelmill.llm import bpe, chat, htmltext, mixing, phrases, pii, quality, rpforest, secrets, sharding, sketch_dedup, span_sql, transducer, whitening
from fennelmill.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("cleaned")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # languages are the sources: their shares differ so much that both the entropy and the limit on passes are below the natural mixture's
    return mixing.summary(table(spark, sf_dir, "documents"), source_column="lang")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shard_rows(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op9 alone, which SQL can say."""
    return pii.base_digests(table(spark, sf_dir, "documents"))


#: In the order of their numbers.
_ALL = (op1_chat_format, op2_quality_rules, op3_html_text, op4_mixing, op5_embedding_dedup, op6_bpe_encode, op7_token_counts, op8_minhash_dedup, op9_pii, op10_secrets, op11_whitening, op12_sharding, op13_phrases, pii_base_spans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return {f.__name__: f for f in _ALL}


_REACHED = """,
r AS (SELECT id, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""

_OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.98){_REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) ON a = vec_id
"""

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 5 THEN array_to_string(t, ' ') ELSE array_to_string(t[i : i + 4], ' ') END AS k FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS i FROM w WHERE len(t) > 0)),
v AS (SELECT doc_id AS id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.k = q.k AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)){_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN v ON v.id = doc_id LEFT JOIN m ON m.id = doc_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op1_chat_format": chat.ORACLE, "op2_quality_rules": quality.ORACLE, "op5_embedding_dedup": _OP5, "op8_minhash_dedup": _OP8, "op10_secrets": span_sql.SECRETS, "op12_sharding": sharding.ORACLE, "op13_phrases": phrases.ORACLE, "pii_base_spans": span_sql.PERSONAL}
