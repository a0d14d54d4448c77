"""Checks of JSON values by type: a walk along the paths of a VARIANT that tells absent from null and both from a wrong type.

A kind is a function of (value, path) that gives the array of 'path: message' of all that is wrong at or below the value, in the
order of the fields. Checks of a value's content follow only where its type is right. Fields that no kind names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.columns import let, strings

Kind = Callable[[Column, Column], Column]

# What is said of a value that is absent, out of range or of another type.
REQUIRED = "Field required"
NO_TEXT, NO_LIST, NO_RECORD = "Input should be a valid string", "Input should be a valid list", "Input should be a valid dictionary or instance of %s"
NO_WHOLE, NO_NUMERAL, FRACTION = "Input should be a valid integer", "Input should be a valid integer, unable to parse string as an integer", "Input should be a valid integer, got a number with a fractional part"
TOO_LOW, TOO_HIGH = "Input should be greater than or equal to %d", "Input should be less than or equal to %d"


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID (a JSON null), ARRAY<..>, OBJECT<..>; null where there is no value."""
    return F.schema_of_variant(value)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def items(value: Column) -> Column:
    """The elements of a JSON array, null where it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def _said(path: Column, message: str | Column) -> Column:
    return F.concat(path, F.lit(": "), F.lit(message) if isinstance(message, str) else message)


def text(check: Callable[[Column], Column] | None = None) -> Kind:
    """A string; check gives what is wrong with one, or null."""

    def walk(value: Column, path: Column) -> Column:
        wrong = check(F.try_variant_get(value, "$", "string")) if check else F.lit(None).cast("string")
        return strings(F.when(kind_of(value) != "STRING", _said(path, NO_TEXT)).when(wrong.isNotNull(), _said(path, wrong)))

    return walk


def one_of(names: tuple[str, ...]) -> Kind:
    quoted = [f"'{n}'" for n in names]
    message = f"Input should be {', '.join(quoted[:-1])} or {quoted[-1]}"

    def walk(value: Column, path: Column) -> Column:
        known = (kind_of(value) == "STRING") & F.try_variant_get(value, "$", "string").isin(*names)
        return strings(F.when(~F.coalesce(known, F.lit(False)), _said(path, message)))

    return walk


def whole(low: int, high: int) -> Kind:
    """A whole number, or a text or a boolean that stands for one, within bounds."""

    def walk(value: Column, path: Column) -> Column:
        def of(kind: Column) -> Column:
            number = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "FLOAT")
            spelled = F.try_variant_get(value, "$", "string")
            numeral = spelled.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$")
            double = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.trim(spelled).try_cast("double"))
            wrong = (
                F.when(~(number | kind.isin("STRING", "BOOLEAN")), NO_WHOLE).when((kind == "STRING") & ~numeral, NO_NUMERAL)
                .when(double != F.floor(double), FRACTION).when(double < low, TOO_LOW % low).when(double > high, TOO_HIGH % high)
            )
            return strings(F.when(wrong.isNotNull(), _said(path, wrong)))

        return let(kind_of(value), of)

    return walk


def list_of(item: Kind, empty: str | None = None) -> Kind:
    """A list of the kind; with a message for an empty one, it must not be empty."""

    def walk(value: Column, path: Column) -> Column:
        def of(own: Column) -> Column:
            below = F.flatten(F.transform(own, lambda x, k: item(x, F.concat(path, F.lit("."), k.cast("string")))))
            return F.when(own.isNull(), strings(_said(path, NO_LIST))).when(F.size(own) == 0, strings(_said(path, empty) if empty else F.lit(None))).otherwise(below)

        return let(items(value), of)

    return walk


def record(name: str, required: dict[str, Kind], optional: dict[str, Kind] | None = None) -> Kind:
    """An object with fields of these kinds. name is what the record is called in messages."""

    def walk(value: Column, path: Column) -> Column:
        def of(field_name: str, kind: Kind, needed: bool) -> Column:
            at = F.when(path == "", F.lit(field_name)).otherwise(F.concat(path, F.lit(f".{field_name}")))
            missing = strings(_said(at, REQUIRED) if needed else F.lit(None))
            return let(field(value, field_name), lambda x: F.when(x.isNull(), missing).otherwise(kind(x, at)))

        every = [of(n, k, True) for n, k in required.items()] + [of(n, k, False) for n, k in (optional or {}).items()]
        return F.when(F.startswith(kind_of(value), F.lit("OBJECT")), F.concat(*every)).otherwise(strings(_said(path, NO_RECORD % name)))

    return walk
