"""Declared schemas and enumerations of the lead tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Lead enumerations.
LEAD_STATUS = ["new", "qualified", "contacted", "converted", "rejected"]
LEAD_QUALITY = ["a", "b", "c", "d", "unknown"]
JOB_STATUS = ["pending", "running", "completed", "failed", "cancelled"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _B = T.StringType(), T.BooleanType()
_LIST = T.ArrayType(_S)

SOURCE_REF = _struct(name=_S, url=_S, scraped_at=_S, fields=_LIST)

SOURCE = _struct(name=_S, display_name=_S, url=_S, source_type=_S, is_active=_B)
