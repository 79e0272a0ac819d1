"""What a table or column is, and eager looks at it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fields(df: DataFrame, path: str = "") -> list[str]:
    """Column names, or the fields of a struct or of a list of structs at a path such as 'jets'."""
    kind: T.DataType = df.schema
    for part in path.split(".") if path else []:
        kind = kind[part].dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
    return list(kind.names) if isinstance(kind, T.StructType) else []


def type_of(df: DataFrame, path: str = "") -> str:
    kind: T.DataType = df.schema
    for part in path.split(".") if path else []:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[part].dataType
    return kind.simpleString()


def backend_of(df: DataFrame) -> str:
    return f"spark {df.sparkSession.version}"


def to_list(df: DataFrame, column: str, ordinal: str, most: int = 1_000_000) -> list:
    """A column's values in order; more than `most` rows are refused."""
    rows = df.select(ordinal, column).orderBy(ordinal).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r[column] for r in rows]


def ndim(df: DataFrame, column: str) -> int:
    """1 for a flat column, and one more for each level of lists."""
    kind, n = df.schema[column].dataType, 1
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n
