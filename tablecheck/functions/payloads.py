"""JSON payload expressions on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def variant(payload: Column, data_type: T.DataType | None = None) -> Column:
    """The payload as VARIANT; text that is not exactly one JSON value is null.

    `try_parse_json` stops after the first value and so accepts trailing text. The
    text is therefore read as the only element of an array. An object without `]` and
    without a comma after a `}` cannot end early in it, which settles most payloads with
    one parse; any other text is also read as the only member of an object: a text that
    closes one of the two early is an error in the other.
    """
    if isinstance(data_type, T.VariantType):
        return payload
    in_array = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}")))
    one_object = F.ltrim(payload).startswith("{") & ~payload.contains("]") & ~payload.rlike(r"\}\s*,")
    return F.when(one_object | in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def is_valid_json(payload: Column) -> Column:
    return variant(payload).isNotNull()


def at(v: Column, path: str) -> Column:
    """Value at a path as VARIANT; null when the path is missing."""
    return F.try_variant_get(v, path, "variant")


def at_as(v: Column, path: str, data_type: str) -> Column:
    return F.try_variant_get(v, path, data_type)


# Names of variant types and the class they belong to.
TYPE_CLASSES = {
    "STRING": "STRING",
    "BIGINT": "NUMBER",
    "DECIMAL": "NUMBER",
    "DOUBLE": "NUMBER",
    "FLOAT": "NUMBER",
    "BOOLEAN": "BOOLEAN",
    "ARRAY": "ARRAY",
    "OBJECT": "OBJECT",
    "VOID": "NULL",
}


def type_class(v: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, ARRAY, OBJECT, NULL (a JSON null) or OTHER.

    One lookup on the leading word of the schema text (`DECIMAL(3,1)`,
    `ARRAY<BIGINT>`): a chain of conditions would derive the schema once per
    branch.
    """
    word = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    classes = F.create_map(*[F.lit(x) for pair in TYPE_CLASSES.items() for x in pair])
    return F.when(v.isNotNull(), F.coalesce(F.element_at(classes, word), F.lit("OTHER")))


def array_size(v: Column, path: str) -> Column:
    """Elements of the array at a path; null when there is no array."""
    return F.size(F.try_variant_get(v, path, "array<variant>")).cast("bigint")


def items(v: Column, path: str) -> Column:
    """The array at a path as array<variant>; null when there is none."""
    return F.try_variant_get(v, path, "array<variant>")
