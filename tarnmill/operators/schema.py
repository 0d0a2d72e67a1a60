"""Schema operators: flattening nested columns, and leaving out columns without values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_schema(schema: T.StructType, leaf_types: str = "string_array", prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of the leaves. Strings and whole arrays are leaves; with leaf_types="all" every other
    type is one too, maps included."""
    if leaf_types not in ("string_array", "all"):
        raise ValueError("leaf_types must be string_array or all")
    paths: list[tuple[str, ...]] = []
    for f in schema.fields:
        at = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            paths += flatten_schema(f.dataType, leaf_types, at)
        elif leaf_types == "all" or isinstance(f.dataType, (T.StringType, T.ArrayType)):
            paths.append(at)
    return paths


def _at(path: tuple[str, ...]):
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def flatten_df(df: DataFrame, leaf_types: str = "string_array", keep_merged: bool = False, sep: str = "_") -> DataFrame:
    """One column for each leaf, named by its path. Names that are equal but for case are one column:
    the first value that is not null, left to right (values of other types than the first are cast
    to it). With keep_merged the others stay, as name_x, name_x2, ..."""
    # Columns are taken by place, as names that differ only in case can't be told apart.
    placed = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    groups: dict[str, list] = {}
    names: dict[str, str] = {}
    for i, f in enumerate(df.schema.fields):
        for p in flatten_schema(T.StructType([f]), leaf_types):
            kind = f.dataType
            for step in p[1:]:
                kind = next(x.dataType for x in kind.fields if x.name == step)
            name = sep.join(p)
            groups.setdefault(name.lower(), []).append((_at((f"__c{i}", *p[1:])), kind))
            names.setdefault(name.lower(), name)
    cols = []
    for key, found in groups.items():
        kind = found[0][1]
        cols.append(F.coalesce(*[c if k == kind else c.cast(kind) for c, k in found]).alias(names[key]))
        if keep_merged:
            cols += [c.alias(f"{names[key]}_x{i if i > 1 else ''}") for i, (c, _) in enumerate(found[1:], 1)]
    return placed.select(*cols)


def _null_counts(df: DataFrame) -> list:
    def missing(f):
        c = _at((f.name,))
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    return [F.count_if(missing(f)).alias(f.name) for f in df.schema.fields]


def null_profile(df: DataFrame) -> DataFrame:
    """One row: for each column the number of nulls (and NaNs of float and double columns)."""
    return df.agg(*_null_counts(df))


def drop_all_null(df: DataFrame) -> DataFrame:
    """`df` without the columns that have no value in any row; an empty table keeps all."""
    *missing, rows = df.agg(*_null_counts(df), F.count("*")).first()
    return df if not rows else df.select(*[_at((c,)) for c, n in zip(df.columns, missing) if n < rows])


def flatten_and_drop_null(df: DataFrame, leaf_types: str = "string_array") -> DataFrame:
    return drop_all_null(flatten_df(df, leaf_types))


def flatten_dict(df: DataFrame, sep: str = "->") -> DataFrame:
    """All leaves of nested structs as columns named by their keys joined by `sep`; empty structs vanish."""
    return df.select(*[_at(p).alias(sep.join(p)) for p in flatten_schema(df.schema, "all")])


def flatten_array(df: DataFrame, column: str) -> DataFrame:
    """`df` with an array of arrays of any depth made one flat array."""
    kind, col = df.schema[column].dataType, F.col(column)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        col, kind = F.flatten(col), kind.elementType
    return df.withColumn(column, col)


def flat_paths(nested: list) -> list:
    """A list of any nesting as a flat list; strings are items."""
    return reduce(lambda out, x: out + (flat_paths(x) if isinstance(x, (list, tuple)) else [x]), nested, [])
