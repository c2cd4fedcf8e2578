"""Types that functions return, as objects, so that modules can be imported before there is a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_NAMES = ("ord", "rule_id", "severity", "category", "line", "matched_text", "description", "recommendation")
FOUND = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("ord", "line") else T.StringType()) for n in _NAMES]))
FOUND_ARROW = pa.list_(pa.struct([(n, pa.int32() if n in ("ord", "line") else pa.string()) for n in _NAMES]))
LOOKED = T.StructType([T.StructField("near", T.IntegerType()), T.StructField("urls", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("context", T.StringType())])))])
