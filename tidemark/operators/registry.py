"""Schemas: registration, compatibility, and validation of payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("NONE", "BACKWARD", "FORWARD", "FULL")
PROPERTIES = "struct<properties:map<string,struct<type:string>>,required:array<string>>"


def latest(schemas: DataFrame) -> DataFrame:
    return schemas.groupBy("subject").agg(F.max(F.struct("version", "id", "schema")).alias("m")).select("subject", "m.version", "m.id", "m.schema")


def with_schema(rows: DataFrame, schemas: DataFrame, subject: Column) -> DataFrame:
    """rows with the latest schema of their subject; a table of a row for each subject, which Spark broadcasts where it is small."""
    known = latest(schemas).select(F.col("subject").alias("_s"), F.col("id").alias("schema_id"), F.col("version").alias("schema_version"), "schema")
    return rows.join(known, subject == F.col("_s"), "left").drop("_s")


def compatible(old: Column, new: Column) -> Column:
    """(backward, forward, full) for the top level of two JSON schemas.

    Backward: what the new one requires the old one required or had as a property, and properties that both have keep their
    type, if both have one. Forward: what the old one requires the new one requires or has; types do not matter. Full: both.
    """
    a, b = F.from_json(old, PROPERTIES), F.from_json(new, PROPERTIES)
    props = lambda s: F.coalesce(s["properties"], F.from_json(F.lit("{}"), "map<string,struct<type:string>>"))
    need = lambda s: F.coalesce(s["required"], F.array().cast("array<string>"))
    shared = F.array_intersect(F.map_keys(props(a)), F.map_keys(props(b)))
    type_ = lambda s, k: F.coalesce(props(s)[k]["type"], F.lit(""))
    same = F.forall(shared, lambda k: (type_(a, k) == type_(b, k)) | (type_(a, k) == "") | (type_(b, k) == ""))
    known = lambda s, k: F.array_contains(F.map_keys(props(s)), k) | F.array_contains(need(s), k)
    backward = same & F.forall(need(b), lambda k: known(a, k))
    forward = F.forall(need(a), lambda k: known(b, k))
    return F.struct(backward.alias("backward"), forward.alias("forward"), (backward & forward).alias("full"))


def successive(schemas: DataFrame) -> DataFrame:
    """Compatibility of each version with the one before, by an equi-join on subject and version."""
    a = schemas.select("subject", (F.col("version") + 1).alias("version"), F.col("schema").alias("_old"))
    return schemas.join(a, ["subject", "version"]).select("subject", "version", compatible(F.col("_old"), F.col("schema")).alias("c")).select("subject", "version", "c.*")


def fingerprint(schema: Column) -> Column:
    """SHA-256 of the schema text with its object keys in order and no blanks."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))

    return F.sha2(canonical(schema).cast("binary"), 256)


class Registry:
    """Schemas of a session's subjects: idempotent registration, versions, compatibility modes. Metadata, kept on the driver."""

    def __init__(self, mode: str = "BACKWARD"):
        self.mode, self.modes, self.rows = mode, {}, []

    def subjects(self) -> list[str]:
        return sorted({r["subject"] for r in self.rows})

    def versions(self, subject: str) -> list[int]:
        return [r["version"] for r in self.rows if r["subject"] == subject]

    def get(self, subject: str, version: int | None = None) -> dict | None:
        rows = [r for r in self.rows if r["subject"] == subject and version in (None, r["version"])]
        return rows[-1] if rows else None

    def by_id(self, schema_id: int) -> dict | None:
        return next((r for r in self.rows if r["id"] == schema_id), None)

    def exists(self, subject: str, schema: str) -> dict | None:
        key = json.dumps(json.loads(schema), sort_keys=True)
        return next((r for r in self.rows if r["subject"] == subject and r["key"] == key), None)

    def test(self, subject: str, schema: str) -> bool:
        last = self.get(subject)
        return last is None or compatible_documents(json.loads(last["schema"]), json.loads(schema), self.modes.get(subject, self.mode))

    def register(self, subject: str, schema: str) -> dict:
        if got := self.exists(subject, schema):
            return got
        if not self.test(subject, schema):
            raise ValueError(f"{subject}: the schema is not {self.modes.get(subject, self.mode)} compatible")
        row = {"id": max((r["id"] for r in self.rows), default=0) + 1, "subject": subject, "version": max(self.versions(subject), default=0) + 1, "schema": schema, "key": json.dumps(json.loads(schema), sort_keys=True)}
        self.rows.append(row)
        return row

    def set_mode(self, mode: str, subject: str | None = None) -> None:
        if mode not in MODES:
            raise ValueError(mode)
        if subject is None:
            self.mode = mode
        else:
            self.modes[subject] = mode

    def delete(self, subject: str, version: int | None = None) -> int:
        gone = [r for r in self.rows if r["subject"] == subject and version in (None, r["version"])]
        self.rows = [r for r in self.rows if r not in gone]
        return len(gone)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(r["id"], r["subject"], r["version"], r["schema"]) for r in self.rows], "id long, subject string, version int, schema string")


def compatible_documents(old: dict, new: dict, mode: str) -> bool:
    a, b = old.get("properties") or {}, new.get("properties") or {}
    types = [((a[k] or {}).get("type"), (b[k] or {}).get("type")) for k in a.keys() & b.keys()]
    before, after = set(old.get("required") or ()), set(new.get("required") or ())
    backward = after <= before | a.keys() and all(x == y or not x or not y for x, y in types)
    forward = before <= after | b.keys()
    return {"NONE": True, "BACKWARD": backward, "FORWARD": forward, "FULL": backward and forward}[mode]


def type_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


class JsonSchema:
    """A validator of JSON values. Lengths are of UTF-8 bytes, patterns match anywhere, an unknown reference is valid, and a
    reference overrides what stands beside it; additionalProperties is read if it is a schema."""

    def __init__(self, document: str | dict):
        self.root = json.loads(document) if isinstance(document, str) else document
        self.patterns: dict[str, re.Pattern] = {}

    def valid(self, value) -> bool:
        return self._ok(self.root, value)

    def valid_text(self, text: str | bytes | None) -> bool:
        try:
            return self.valid(json.loads(text))
        except (TypeError, ValueError):
            return False

    def _ok(self, s, v) -> bool:
        if not isinstance(s, dict):
            return True
        if ref := s.get("$ref"):
            m = re.fullmatch(r"#/(definitions|\$defs)/([^/]+)", ref)
            target = (self.root.get(m[1]) or {}).get(m[2]) if m else None
            return target is None or self._ok(target, v)
        kind = type_of(v)
        wanted = s.get("type")
        if wanted is not None:
            wanted = [wanted] if isinstance(wanted, str) else wanted
            if kind not in wanted and not (kind == "integer" and "number" in wanted):
                return False
        if "enum" in s and not any(type_of(e) == kind and e == v for e in s["enum"]):
            return False
        checks = {"object": self._object, "array": self._array, "string": self._string, "integer": self._number, "number": self._number}
        if kind in checks and not checks[kind](s, v):
            return False
        return (
            all(self._ok(x, v) for x in s.get("allOf", ())) and ("anyOf" not in s or any(self._ok(x, v) for x in s["anyOf"])) and ("oneOf" not in s or sum(self._ok(x, v) for x in s["oneOf"]) == 1)
            and ("not" not in s or not self._ok(s["not"], v))
        )

    def _object(self, s, v) -> bool:
        props, more = s.get("properties") or {}, s.get("additionalProperties")
        return all(k in v for k in s.get("required") or ()) and all(self._ok(props[k], x) if k in props else self._ok(more, x) for k, x in v.items())

    def _array(self, s, v) -> bool:
        return s.get("minItems", 0) <= len(v) <= s.get("maxItems", len(v)) and all(self._ok(s.get("items"), x) for x in v)

    def _string(self, s, v) -> bool:
        n = len(v.encode())
        if not s.get("minLength", 0) <= n <= s.get("maxLength", n):
            return False
        p = s.get("pattern")
        if p is None:
            return True
        if p not in self.patterns:
            self.patterns[p] = re.compile(p)
        return self.patterns[p].search(v) is not None

    def _number(self, s, v) -> bool:
        return s.get("minimum", v) <= v <= s.get("maximum", v)


def validate(payload: Column, schema: Column) -> Column:
    """Whether a JSON payload is valid under its row's schema, in Arrow batches; schemas are compiled once a batch."""

    @F.pandas_udf("boolean")
    def check(payloads: pd.Series, documents: pd.Series) -> pd.Series:
        known = {d: JsonSchema(d) for d in documents.dropna().unique()}
        return pd.Series([None if d is None else known[d].valid_text(p) for p, d in zip(payloads, documents)], dtype=object)

    return check(payload, schema)


def flat_valid(payload: Column, required: dict[str, str]) -> Column:
    """The same without Python for flat schemas: required fields by name and JSON type."""
    from ..functions.scalars import json_type

    ok = payload.isNotNull() & F.get_json_object(payload, "$").isNotNull()
    for name, kind in required.items():
        got = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "string")
        typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))
        want = {"integer": ["BIGINT"], "string": ["STRING"], "boolean": ["BOOLEAN"]}.get(kind)
        ok = ok & got.isNotNull() & (typed.isin(*want) if want else json_type(got).isNotNull())
    return F.coalesce(ok, F.lit(False))


def avro_errors(document: str) -> list[str]:
    """What is wrong with an Avro schema; empty if nothing."""
    primitive = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}
    try:
        root = json.loads(document)
    except ValueError:
        return ["not JSON"]
    named: set[str] = set()

    def walk(s) -> list[str]:
        if isinstance(s, str):
            return [] if s in primitive or s in named else [f"unknown type {s}"]
        if isinstance(s, list):
            return [e for x in s for e in walk(x)]
        if not isinstance(s, dict) or "type" not in s:
            return ["a schema needs a type"]
        t, out = s["type"], []
        if t in ("record", "enum", "fixed"):
            out += [] if s.get("name") else [f"{t} needs a name"]
            named.add(s.get("name"))
        if t == "record":
            fields = s.get("fields")
            out += ["record needs fields"] if not isinstance(fields, list) else [e for f in fields for e in (["field needs a name"] if not f.get("name") else []) + walk(f.get("type", {}))]
        elif t == "enum":
            out += [] if s.get("symbols") else ["enum needs symbols"]
        elif t == "fixed":
            out += [] if isinstance(s.get("size"), int) and s["size"] > 0 else ["fixed needs a size"]
        elif t == "array":
            out += walk(s["items"]) if "items" in s else ["array needs items"]
        elif t == "map":
            out += walk(s["values"]) if "values" in s else ["map needs values"]
        else:
            out += walk(t)
        return out

    return walk(root)


def avro_payload_ok(payload: bytes | None) -> bool:
    """Bytes that look like JSON must parse; others only need to be there."""
    if not payload:
        return False
    if payload[:1] in (b"{", b"["):
        try:
            json.loads(payload)
        except ValueError:
            return False
    return True


def protobuf_errors(document: str) -> list[str]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", document, flags=re.S)
    out = [] if re.search(r'\bsyntax\s*=\s*"proto[23]"', text) else ["no syntax of proto2 or proto3"]
    out += [] if re.search(r"\bmessage\s+\w+\s*\{", text) else ["no message"]
    return out + ([] if text.count("{") == text.count("}") else ["braces do not match"])


def protobuf_payload_ok(payload: bytes | None) -> bool:
    """The first tag's wire type must be one of 0, 1, 2, 5."""
    return bool(payload) and payload[0] & 7 in (0, 1, 2, 5)
