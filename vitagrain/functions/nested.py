"""Work on nested records whatever their depth (Spark SQL expression text from a schema)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitagrain.functions import text as tx


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def has_text(kind: T.DataType) -> bool:
    """Whether a type holds strings anywhere."""
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def cleaned(value: str, kind: T.DataType, depth: int = 0) -> str:
    """Clean every string of a value; list items that become empty drop out, at any depth.

    Struct fields and map values stay even when they become empty, map keys are left
    alone, and null stays null. One expression for the whole schema; parts without
    strings are not touched.
    """
    if not has_text(kind):
        return value
    if isinstance(kind, T.ArrayType):
        x = f"v{depth}"
        items = f"transform({value}, {x} -> {cleaned(x, kind.elementType, depth + 1)})"
        if isinstance(kind.elementType, T.StringType):
            items = f"filter({items}, {x} -> {x} IS NULL OR {x} <> '')"
        return items
    if isinstance(kind, T.MapType):
        k, x = f"k{depth}", f"v{depth}"
        return f"transform_values({value}, ({k}, {x}) -> {cleaned(x, kind.valueType, depth + 1)})"
    if isinstance(kind, T.StructType):
        fields = ", ".join(
            f"'{f.name}', {cleaned(f'{value}.{_quoted(f.name)}', f.dataType, depth)}" for f in kind.fields)
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"
    return f"CASE WHEN {value} IS NOT NULL THEN {tx.clean(value)} END"


def cleaned_column(name: str, kind: T.DataType) -> Column:
    """The cleaned column under its own name."""
    return F.expr(cleaned(_quoted(name), kind)).alias(name)


def replaced(items: str, fixes: Column, fields: list[str]) -> Column:
    """An array of structs with single fields of single elements replaced.

    ``fixes`` is a map from the element's position (from 0) to a struct of new values;
    where a position or a new value is absent the element keeps its own. Siblings and
    all other fields stay as they are.
    """
    def element(x: Column, i: Column) -> Column:
        for f in fields:
            x = x.withField(f, F.coalesce(fixes[i][f], x[f]))
        return x

    return F.transform(items, element)
