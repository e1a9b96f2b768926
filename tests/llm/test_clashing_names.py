"""Operators that keep a table's columns keep them whatever their names are."""

from fennelmill.llm import mixing, pii, quality, sketch_dedup

INNER = ["__kept", "__cleaned", "__lost", "__gone", "__spans", "__hash", "__of_id", "__of_hash", "__weight", "__key", "__skey", "__block", "__part", "___key", "__KEPT2", "__again", "c0", "c1", "kept", "cleaned", "skey", "pos", "id"]


def test_columns_of_any_name_pass_through_the_stages(spark):
    text = lambda i: "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + k)}{chr(97 + n)}" for n in range(12)) + "." for k in range(3))
    rows = [(i, text(i) + (" Write to a@b.cc now." if i == 1 else ""), "s", *(f"{c}={i}" for c in INNER)) for i in range(3)] + [(9, text(0), "s", *(f"{c}=9" for c in INNER))]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in INNER)]))
    for stage, left in ((quality.clean, 4), (sketch_dedup.drop_duplicates, 3), (pii.redact, 4), (lambda d: mixing.mix(d).drop(*mixing.ADDED), 4)):
        out = stage(df)
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == left and all(r[c] == f"{c}={r.doc_id}" for r in got for c in INNER)
