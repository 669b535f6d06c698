"""NumPy dtypes and the Spark types that hold them; the exact dtype travels in a field's metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

KEY = "np_dtype"
_TO = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_FROM = {T.BooleanType: "?", T.ByteType: "i1", T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8", T.StringType: "U", T.BinaryType: "S", T.DateType: "M8[D]", T.TimestampNTZType: "M8[us]", T.DayTimeIntervalType: "m8[us]"}


def spark_type(dtype: np.dtype) -> T.DataType:
    """The Spark type of a storable dtype; TypeError for any other."""
    if dtype.kind in "SU":
        return T.BinaryType() if dtype.kind == "S" else T.StringType()
    if dtype.kind == "M":
        return T.DateType() if dtype == np.dtype("M8[D]") else T.TimestampNTZType()
    if dtype.kind == "m":
        return T.DayTimeIntervalType()
    if (key := dtype.str[1:]) not in _TO:
        raise TypeError(f"dtype {dtype} can't be stored")
    return _TO[key]


def numpy_type(field: T.StructField) -> np.dtype:
    """The dtype a field stands for; TypeError for nested types and for timestamps of a zone."""
    if KEY in (field.metadata or {}):
        return np.dtype(field.metadata[KEY])
    if isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0 and field.dataType.precision == 20:
        return np.dtype("u8")
    for kind, name in _FROM.items():
        if isinstance(field.dataType, kind):
            return np.dtype(name)
    raise TypeError(f"column {field.name!r}: {field.dataType.simpleString()} is nested, zoned or unsupported")


def field(name: str, dtype: np.dtype) -> T.StructField:
    return T.StructField(name, spark_type(dtype), False, {KEY: dtype.str})
