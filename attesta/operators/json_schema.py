"""JSON Schema documents compiled to expressions over JSON texts: what breaks which rule, and where.

``violations`` compiles a schema (the keywords below, and local $ref) to one Column that walks a
variant, so a table of documents is checked in one pass without Python. A violation names the place by a JSON
pointer, the keyword, and what it is about (a missing or unknown key, or the value's type).

Keywords: type, const, enum, pattern, minLength, maxLength, minimum, maximum, minItems, maxItems,
uniqueItems, items, required, properties, additionalProperties (false), $ref, $defs; titles and
descriptions are passed over. Others are refused when the schema is compiled, and so is a
schema that refers to itself.

Edge cases: a null or malformed text breaks the keyword `json` at the root; an explicit null is a
value of type null and not a missing key; keywords for one type hold for values of others;
1.0 is an integer; patterns are found anywhere unless they are anchored; lengths are code points.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import let

FOUND = "array<struct<pointer:string,keyword:string,detail:string>>"
PASSED = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
KEYWORDS = {
    "type", "const", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "uniqueItems", "items", "required", "properties",
    "additionalProperties", "$ref",
}


def step(key: str) -> str:
    """A key as a part of a JSON pointer."""
    return "/" + key.replace("~", "~0").replace("/", "~1")


def path(key: str) -> str:
    """A key as a path into a variant, which knows no escapes."""
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes: {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, integer, number, boolean or null."""
    name = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(name == "OBJECT", "object")
        .when(name == "ARRAY", "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when((name == "BIGINT") | (whole == F.floor(whole)), "integer")
        .otherwise("number")
    )


def equals(v: Column, of: Column, value: Any) -> Column:
    """Whether a variant of a type is a JSON value."""
    if isinstance(value, bool) or value is None or isinstance(value, dict | list):
        return F.to_json(v) == json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    if isinstance(value, str):
        return (of == "string") & (F.try_variant_get(v, "$", "string") == value)
    return of.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))


class Compiler:
    def __init__(self, schema: dict[str, Any]):
        self.root = schema

    def resolved(self, schema: dict[str, Any], seen: tuple[str, ...]) -> tuple[dict[str, Any], tuple[str, ...]]:
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen or not ref.startswith("#"):
                raise ValueError(f"a schema that refers to itself or to another document: {ref}")
            seen, target = (*seen, ref), self.root
            for part in filter(None, ref[1:].split("/")):
                target = target[part.replace("~1", "/").replace("~0", "~")]
            schema = {**target, **{k: x for k, x in schema.items() if k != "$ref"}}
        unknown = set(schema) - KEYWORDS - PASSED
        if unknown:
            raise ValueError(f"keywords that are not known: {sorted(unknown)}")
        return schema, seen

    def errors(self, v: Column, schema: dict[str, Any], at: Column, seen: tuple[str, ...] = ()) -> Column:
        """What a variant breaks at a place: FOUND."""
        schema, seen = self.resolved(schema, seen)

        def node(value: Column) -> Column:
            return let(kind(value), lambda of: self.checks(value, of, schema, at, seen))

        return let(v, node)

    def errors_of(self, value: Column, schema: dict[str, Any], at: Column, seen: tuple[str, ...]) -> Column:
        """The errors of what may be missing."""
        return let(value, lambda p: F.when(p.isNotNull(), self.errors(p, schema, at, seen)))

    def checks(self, v: Column, of: Column, s: dict[str, Any], at: Column, seen: tuple[str, ...]) -> Column:
        def unless(holds: Column, keyword: str, detail: Column | None = None) -> Column:
            found = F.struct(at.alias("pointer"), F.lit(keyword).alias("keyword"), (detail if detail is not None else F.lit("")).alias("detail"))
            return F.when(~F.coalesce(holds, F.lit(False)), found)

        def only(type_: str, holds: Column) -> Column:
            return (of != type_) | holds

        single: list[Column] = []
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        if "type" in s:
            types = [s["type"]] if isinstance(s["type"], str) else list(s["type"])
            single.append(unless(of.isin(*types, *(["integer"] if "number" in types else [])), "type", of))
        if "const" in s:
            single.append(unless(equals(v, of, s["const"]), "const"))
        if "enum" in s:
            holds = F.lit(False)
            for value in s["enum"]:
                holds = holds | equals(v, of, value)
            single.append(unless(holds, "enum"))
        if "pattern" in s:
            single.append(unless(only("string", F.rlike(text, F.lit(s["pattern"]))), "pattern"))
        for keyword, test in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n)):
            if keyword in s:
                single.append(unless(only("string", test(s[keyword])), keyword))
        for keyword, test in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n)):
            if keyword in s:
                single.append(unless(~of.isin("integer", "number") | test(s[keyword]), keyword))
        items = F.try_variant_get(v, "$", "array<variant>")
        for keyword, test in (("minItems", lambda n: F.size(items) >= n), ("maxItems", lambda n: F.size(items) <= n)):
            if keyword in s:
                single.append(unless(only("array", test(s[keyword])), keyword))
        if s.get("uniqueItems"):
            shown = F.transform(items, lambda x: F.to_json(x))
            single.append(unless(only("array", F.size(F.array_distinct(shown)) == F.size(shown)), "uniqueItems"))
        for key in s.get("required", []):
            single.append(unless(only("object", F.try_variant_get(v, path(key), "variant").isNotNull()), "required", F.lit(key)))
        out = [F.array_compact(F.array(*single)).cast(FOUND)] if single else []
        known = s.get("properties", {})
        if s.get("additionalProperties") is False:
            keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")))
            told = F.transform(extra, lambda k: F.struct(at.alias("pointer"), F.lit("additionalProperties").alias("keyword"), k.alias("detail")))
            out.append(F.when(of == "object", told).cast(FOUND))
        elif "additionalProperties" in s and s["additionalProperties"] is not True:
            raise ValueError("additionalProperties is true or false")
        if "items" in s:
            each = F.transform(items, lambda x, i: self.errors(x, s["items"], F.concat(at, F.lit("/"), i.cast("string")), seen))
            out.append(F.when(of == "array", F.flatten(each)).cast(FOUND))
        for key, inner in known.items():
            out.append(F.when(of == "object", self.errors_of(F.try_variant_get(v, path(key), "variant"), inner, F.concat(at, F.lit(step(key))), seen)).cast(FOUND))
        empty = F.array().cast(FOUND)
        return F.concat(empty, *[F.coalesce(x, empty) for x in out])


def compiled(schema: dict[str, Any], raw: Column) -> Column:
    """The violations (FOUND) of a JSON text."""
    unread = F.array(F.struct(F.lit("").alias("pointer"), F.lit("json").alias("keyword"), F.lit("").alias("detail"))).cast(FOUND)
    compiler = Compiler(schema)
    return let(F.try_parse_json(raw), lambda v: F.when(v.isNull(), unread).otherwise(compiler.errors(v, schema, F.lit(""))))


def violations(rows: DataFrame, schema: dict[str, Any], key: str, raw: str = "raw") -> DataFrame:
    """key, pointer, keyword and detail: a row for every rule that a row's JSON text breaks."""
    return rows.select(key, F.explode(compiled(schema, F.col(raw))).alias("v")).select(key, "v.*")
