"""Bring files with differing nested types to a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform_column(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """Cast with two additions: fields match by name, nested values become JSON text."""
    if have == want:
        return value
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(want, T.StringType) and isinstance(have, nested):
        return F.to_json(value)
    if isinstance(want, T.StringType) and isinstance(have, T.VariantType):
        return F.to_json(value)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        present = set(have.fieldNames())
        fields = [
            conform_column(value[f.name], have[f.name].dataType, f.dataType).alias(f.name)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(
            value, lambda item: conform_column(item, have.elementType, want.elementType)
        )
    if isinstance(want, (T.StructType, T.ArrayType)):
        # A value of another shape counts as missing, as an unusable row does.
        return F.lit(None).cast(want)
    return value.try_cast(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns first, absent ones null; further columns follow unchanged."""
    present = {f.name: f.dataType for f in df.schema.fields}
    declared = [
        conform_column(F.col(f.name), present[f.name], f.dataType).alias(f.name)
        if f.name in present
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    extra = [name for name in present if name not in set(schema.fieldNames())]
    return df.select(*declared, *extra)
