"""Closed JSON shapes: declared once, checked as columns on data at rest and as Python in a call loop.

A shape says which keys a JSON object must have and what each value may be; any other key is an error.
`from_json` alone cannot tell a missing key from a null or an unknown one, and turns numbers into text. So
the column form takes two things from a text, each once: the type of every key, spelled by
`schema_of_variant` and matched by one pattern per key, and the typed values for bounds, lengths and
vocabularies.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

_URL = r"(?i)^https?://[^\s/?#]*[^\s/?#@:][^\s/?#]*([/?#].*)?$"
# Dates and stamps must match as a whole; `$` would let a line break follow.
_DATE = r"\d{4}-\d{2}-\d{2}"
_STAMP = r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_MAX_URL = 2083


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class Text:
    """A JSON string; `form` may be url, date or timestamp."""

    min_len: int = 0
    max_len: int | None = None
    choices: tuple[str, ...] = ()
    form: str | None = None
    nullable: bool = False

    ddl = "string"

    def pattern(self) -> str:
        return "(?:STRING|VOID)" if self.nullable else "STRING"

    def typed_ok(self, text: Column) -> Column:
        good = F.lit(True)
        if self.min_len:
            good &= F.length(text) >= self.min_len
        if self.max_len is not None:
            good &= F.length(text) <= self.max_len
        if self.choices:
            good &= text.isin(*self.choices)
        if self.form == "url":
            good &= text.rlike(_URL) & (F.length(text) <= _MAX_URL)
        elif self.form == "date":
            good &= text.rlike(rf"\A(?:{_DATE})\z") & text.try_cast("date").isNotNull()
        elif self.form == "timestamp":
            good &= text.rlike(rf"\A(?:{_STAMP})\z") & text.try_cast("timestamp").isNotNull()
        return text.isNull() | good if self.nullable else text.isNotNull() & good

    def problem(self, value: Any) -> str | None:
        if value is None and self.nullable:
            return None
        if not isinstance(value, str):
            return "not text"
        if len(value) < self.min_len or (self.max_len is not None and len(value) > self.max_len):
            return "length"
        if self.choices and value not in self.choices:
            return "vocabulary"
        if self.form == "url" and (not re.search(_URL, value) or len(value) > _MAX_URL):
            return "url"
        if self.form == "date":
            try:
                good = re.fullmatch(_DATE, value) and date.fromisoformat(value)
            except ValueError:
                good = None
            return None if good else "date"
        if self.form == "timestamp":
            try:
                good = re.fullmatch(_STAMP, value) and datetime.fromisoformat(value.replace(" ", "T").upper())
            except ValueError:
                good = None
            return None if good else "timestamp"
        return None

    def json_schema(self) -> dict:
        schema: dict[str, Any] = {"type": ["string", "null"] if self.nullable else "string"}
        if self.min_len:
            schema["minLength"] = self.min_len
        if self.max_len is not None:
            schema["maxLength"] = self.max_len
        if self.choices:
            schema["enum"] = list(self.choices)
        if self.form:
            schema["format"] = {"url": "uri", "date": "date", "timestamp": "date-time"}[self.form]
        return schema


@dataclass(frozen=True)
class Rating:
    """A JSON integer within bounds: no text, no fraction (not even 5.0), no boolean."""

    low: int = 0
    high: int = 10

    ddl = "bigint"

    def pattern(self) -> str:
        return "BIGINT"

    def typed_ok(self, number: Column) -> Column:
        return number.between(self.low, self.high)

    def problem(self, value: Any) -> str | None:
        if isinstance(value, bool) or not isinstance(value, int):
            return "not an integer"
        return None if self.low <= value <= self.high else "bounds"

    def json_schema(self) -> dict:
        return {"type": "integer", "minimum": self.low, "maximum": self.high}


@dataclass(frozen=True)
class Number:
    """A finite number; numbers written as text and booleans count too."""

    ddl = "string"

    def pattern(self) -> str:
        return r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)|STRING)"

    def typed_ok(self, text: Column) -> Column:
        number = text.try_cast("double")
        # Infinity minus itself is not a number, so the difference is 0 only for finite values.
        return text.rlike(_NUMBER) & (number - number == 0.0)

    def problem(self, value: Any) -> str | None:
        if isinstance(value, str):
            if not re.search(_NUMBER, value):
                return "not a number"
            value = float(value)
        if not isinstance(value, (int, float)):
            return "not a number"
        return None if math.isfinite(value) else "not finite"

    def json_schema(self) -> dict:
        return {"type": "number"}


@dataclass(frozen=True)
class Items:
    """A JSON array of one shape."""

    item: Any
    max_len: int | None = None

    @property
    def ddl(self) -> str:
        return f"array<{self.item.ddl}>"

    def pattern(self) -> str:
        # An empty array, or one of nulls only, has no item type; nulls beside items show in the values only.
        return f"ARRAY<(?:VOID|{self.item.pattern()})>"

    def typed_ok(self, array: Column) -> Column:
        good = F.forall(array, lambda item: _true(self.item.typed_ok(item)))
        return good if self.max_len is None else (F.size(array) <= self.max_len) & good

    def problem(self, value: Any) -> str | None:
        if not isinstance(value, list):
            return "not an array"
        if self.max_len is not None and len(value) > self.max_len:
            return "too many items"
        return next((found for found in map(self.item.problem, value) if found), None)

    def json_schema(self) -> dict:
        schema = {"type": "array", "items": self.item.json_schema()}
        if self.max_len is not None:
            schema["maxItems"] = self.max_len
        return schema


@dataclass(frozen=True)
class AnyObject:
    """A JSON object with any content, kept as text."""

    ddl = "string"

    def pattern(self) -> str:
        # Any content could imitate what follows, so this pattern must stand at the end of a field and a
        # shape that holds it has no other fields.
        return "OBJECT<.*>"

    def typed_ok(self, text: Column) -> Column:
        return text.isNotNull()

    def problem(self, value: Any) -> str | None:
        return None if isinstance(value, dict) else "not an object"

    def json_schema(self) -> dict:
        return {"type": "object"}


@dataclass(frozen=True)
class Closed:
    """A JSON object with exactly the declared keys; keys named in `optional` may be absent."""

    fields: Mapping[str, Any]
    optional: frozenset[str] = field(default_factory=frozenset)

    @property
    def ddl(self) -> str:
        return "struct<" + ",".join(f"{name}:{shape.ddl}" for name, shape in self.fields.items()) + ">"

    def pattern(self) -> str:
        """Pattern of the type text; it lists the keys of an object in alphabetical order."""
        parts = []
        for name in sorted(self.fields):
            part = f"{name}: {self.fields[name].pattern()}(?:, |(?=>))"
            parts.append(f"(?:{part})?" if name in self.optional else part)
        return "OBJECT<" + "".join(parts) + ">"

    def typed_ok(self, struct: Column) -> Column:
        good = struct.isNotNull()
        for name, shape in self.fields.items():
            inner = _true(shape.typed_ok(struct[name]))
            good &= (struct[name].isNull() | inner) if name in self.optional else inner
        return good

    def with_problem(self, rows: DataFrame, text: str, name: str, typed: str = "_typed") -> DataFrame:
        """Adds `name`, the first fault of a JSON text column, and `typed`, its values.

        The fault is `malformed`, `unknown_field` or the field at fault; null if there is none. Types and
        values come from projections of their own, so that a text is not parsed again for every field.
        """
        # The parser ignores what follows a complete value. A mark behind the text, in one array with it,
        # only turns up in its place if nothing does.
        mark = F.xxhash64(F.col(text))
        marked = F.concat(F.lit("["), F.col(text), F.lit(","), mark.cast("string"), F.lit("]"))
        whole = F.try_variant_get("_parsed", "$[1]", "long") == mark
        values = F.col(typed)
        good = F.schema_of_variant("_object").rlike(f"^{self.pattern()}$") & self.typed_ok(values)
        # Only faulty rows are taken apart. A JSON null arrives as a missing value of a present key.
        spelled = F.transform_values(
            F.try_variant_get("_object", "$", "map<string,variant>"),
            lambda _, value: F.coalesce(F.schema_of_variant(value), F.lit("VOID")),
        )
        kinds = F.col("_kinds")
        allowed = F.array(*[F.lit(field) for field in self.fields])
        checks = [
            F.when(kinds.isNull(), F.lit("malformed")),
            F.when(F.size(F.array_except(F.map_keys(kinds), allowed)) > 0, F.lit("unknown_field")),
        ]
        for field, shape in self.fields.items():
            kind = kinds[field]
            fine = _true(kind.rlike(f"^{shape.pattern()}$") & shape.typed_ok(values[field]))
            if isinstance(shape, Number):
                fine |= _true(kind == "BOOLEAN")
            if field in self.optional:
                fine |= kind.isNull()
            checks.append(F.when(~fine, F.lit(field)))
        return (
            rows.withColumn("_parsed", F.try_parse_json(marked))
            .withColumn("_object", F.when(whole, F.try_variant_get("_parsed", "$[0]", "variant")))
            .withColumn(typed, F.from_json(F.col(text), self.ddl))
            .withColumn("_good", _true(good))
            .withColumn("_kinds", F.when(~F.col("_good"), spelled))
            .withColumn(name, F.when(~F.col("_good"), F.coalesce(*checks)))
            .drop("_parsed", "_object", "_good", "_kinds")
        )

    def problem(self, value: Any) -> str | None:
        if not isinstance(value, dict):
            return "malformed"
        if value.keys() - self.fields.keys():
            return "unknown_field"
        for name, shape in self.fields.items():
            if name not in value:
                if name not in self.optional:
                    return name
            elif shape.problem(value[name]):
                return name
        return None

    def json_schema(self) -> dict:
        return {
            "type": "object",
            "properties": {name: shape.json_schema() for name, shape in self.fields.items()},
            "required": [name for name in self.fields if name not in self.optional],
            "additionalProperties": False,
        }


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def text_problem(shape: Closed, text: str | None) -> str | None:
    """Fault of a JSON text, for use inside a call loop; null if it has the shape.

    Repeated keys, nesting beyond what a parser can follow and numbers beyond a double are malformed, as in columns.
    """
    try:
        value = json.loads(text or "", parse_constant=_no_constant, object_pairs_hook=_no_repeats)
        return shape.problem(value)
    except (ValueError, OverflowError, RecursionError):
        return "malformed"
