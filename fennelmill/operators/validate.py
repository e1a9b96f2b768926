"""Documents held against a JSON Schema that the user brings, as rows of what each breaks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the JSON text of a value looks like, by type.
_LOOKS = {"string": '^"', "object": r"^\{", "array": r"^\[", "boolean": "^(true|false)$", "null": "^null$", "number": r"^-?[0-9]", "integer": r"^-?[0-9]+(\.0+)?$"}

Test = Callable[[Column], Column]


def read_schema(spark: SparkSession, path: str) -> dict:
    """A schema from a JSON file, wherever Spark can read it."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _is(value: Column, kinds: str | list[str]) -> Column:
    kinds = [kinds] if isinstance(kinds, str) else kinds
    return F.to_json(value).rlike("|".join(_LOOKS[k] for k in kinds))


def _child(value: Column, name: str) -> Column:
    """A field of an object; NULL where it is missing, a variant null where it is null."""
    return F.try_variant_get(value, "$[{}]".format(json.dumps(name)), "variant")


def _within(name: str, test: Test) -> Test:
    return lambda value: test(_child(value, name))


def _any_element(test: Test) -> Test:
    return lambda value: F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda e: F.coalesce(test(e), F.lit(False)))


def tests_of(schema: dict, path: str = "") -> Iterator[tuple[str, str, Test]]:
    """``(path, keyword, test)`` of each rule: the test is true for a value that breaks it, and not true for none at all.

    Read are ``type`` (one or several), ``enum``, ``required``, ``properties`` and ``items``, at any depth; a rule of an
    array's elements is broken if any element breaks it. Other keywords are allowed and not checked.
    """
    if "type" in schema:
        yield path, "type", lambda v: ~_is(v, schema["type"])
    if "enum" in schema:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        yield path, "enum", lambda v: ~F.to_json(v).isin(allowed)
    at = lambda name: f"{path}.{name}" if path else name
    for name in schema.get("required", ()):
        yield at(name), "required", lambda v, name=name: _is(v, "object") & _child(v, name).isNull()
    for name, inner in schema.get("properties", {}).items():
        for place, keyword, test in tests_of(inner, at(name)):
            yield place, keyword, _within(name, test)
    if "items" in schema:
        for place, keyword, test in tests_of(schema["items"], f"{path}[]"):
            yield place, keyword, _any_element(test)


def violations(docs: DataFrame, doc: str, key: str, schema: dict) -> DataFrame:
    """``(key, path, rule)`` of each rule of ``schema`` that a JSON document breaks; a text that is no object breaks ``json``.

    A document is parsed once, into a variant, and all rules look at that. Extra fields are allowed, formats not checked.
    """
    parsed = docs.select(key, F.try_parse_json(doc).alias("parsed"))
    value = F.col("parsed")
    whole = F.coalesce(_is(value, "object"), F.lit(False))
    named = lambda path, rule: F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))
    found = [F.when(~whole, named("", "json"))] + [F.when(whole & test(value), named(path, rule)) for path, rule, test in tests_of(schema)]
    return parsed.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.path", "v.rule")


def constraint_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` of each constraint that a row fails; a constraint that is NULL is not failed."""
    found = [F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("rule"))
