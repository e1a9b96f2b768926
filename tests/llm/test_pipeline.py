"""The pipeline's stages, and that the whole keeps what it should."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from fennelmill.llm import mixing, quality
from fennelmill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def line(key):
    """A sentence of words that its key draws."""
    rng = random.Random(key)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(18)) + " glad."


def rows():
    clean = [(i, "\n".join(line(f"{i}-{k}") for k in range(3)), "en", "s0" if i % 2 else "s1") for i in range(20)]
    near = [(100, clean[3][1].replace("glad", "sad", 1), "en", "s0"), (101, clean[4][1], "en", "s0")]
    bad = [(200, "short", "en", "s0"), (201, None, "en", None), (202, "x " * 50, "en", "s0"), (203, "a | b | c | d\n" * 9 + "e f g h i j k l.", "en", "s0")]
    personal = [(300, "\n".join([line(f"p{k}") for k in range(3)]) + " Write to a@b.cc now.", "en", "s1")]
    return [(*r, len(r[1] or ""), "e") for r in clean + near + bad + personal]


def test_stages(spark, tmp_path):
    data = rows()
    docs = spark.createDataFrame(data, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialise(stage(spark, at, str(tmp_path)), "t")
        assert at.columns == docs.columns
        seen[name] = at.collect()
    assert {r.doc_id for r in seen["quality rules"]} == {r[0] for r in data} - {200, 201, 202, 203}
    assert {r.doc_id for r in seen["MinHash near-dedup"]} == set(range(20)) | {300}
    assert any("[EMAIL]" in r.text and r.doc_id == 300 and r.n_chars == len(r.text) for r in seen["PII"])
    assert {r.doc_id for r in seen["mixing sources to target weights"]} == set(range(20)) | {300}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in seen["PII"]}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(seen["mixing sources to target weights"])
    for r in out:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_order_of_the_stream_is_kept(spark, tmp_path):
    """Positions count the written stream from 0, and it is the mixture's order."""
    data = [(i, "\n".join(line(f"{i}-{k}") for k in range(3)), "en" if i % 4 else "de", "s", 0, "e") for i in range(120)]
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = corpus_pipeline.materialise(dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, str(tmp_path)), "mixed")
    assert mixed.columns == docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, mixed, str(tmp_path)).orderBy("position").collect()
    want = [r.doc_id for r in mixing.mix(docs, source_column="lang").orderBy("mix_slot", "mix_order").collect()]
    assert [r.position for r in out] == list(range(len(want))) and [r.doc_id for r in out] == want and len(want) > 120


def test_nulls_long_texts_and_clashing_names_end_to_end(spark, tmp_path):
    clean = [(i if i % 5 else None, "\n".join(line(f"{i}-{k}") for k in range(3)), "en", None if i % 3 else "s", 0, "e") for i in range(12)]
    long = "\n".join(line(f"long{k}") for k in range(2000))
    schema = DOCS + ", position string, `_metadata` int, kept int, `a.b` int"
    rows = [(*r, "p", 1, 2, 3) for r in [*clean, (77, long, None, "s", 0, "e"), (None, None, None, None, None, None), (78, "", "", "", 0, "")]]
    spark.createDataFrame(rows, schema.replace(", `_metadata` int", ", meta int")).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in clean} | {77} and max(r.n_tokens for r in out) > 20_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_are_parameters(spark):
    df = spark.createDataFrame([(1, line(1) + "\n" + line(2))], "doc_id long, text string")
    assert quality.assess(df, quality.LineRules(loss=-1.0)).first().kept is False


def test_scratch_of_a_stage_goes_when_its_result_is_written(spark, tmp_path):
    from fennelmill.llm import common

    spark.createDataFrame(rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(common._made)
    corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[-1].split("-")[0] for p in common._made if p not in before]
    assert left == ["stage3"]
