"""Schemas of the nested input files and of the catalogue tables."""
from __future__ import annotations

from pyspark.sql import types as T

_text, _real, _whole, _id, _flag = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PROGRAM = _struct(
    name=_text, code=_text, global_specialty=_text, qualification=_text, qualification_name=_text,
    cost=_text, duration=_text, level=_text, source=_text,
)
INSTITUTION_FILE = _struct(
    id=_id, institution_id=_id, name=_text, type=_text, location=_text, address=_text, website=_text, email=_text,
    phone=_text, latitude=_real, longitude=_real, description1=_text, description2=_text, description3=_text,
    directions=_text, dormitory=_flag, grants=_flag, verified=_text, ok=_flag, error=_text,
    specialties=T.ArrayType(PROGRAM), programs=T.ArrayType(PROGRAM),
)
# A file holds either an object with ``institutions`` or a bare list of institutions.
CATALOG_FILE = T.StructType([T.StructField("institutions", T.ArrayType(INSTITUTION_FILE)), *INSTITUTION_FILE.fields])

INSTITUTION = _struct(
    institution_id=_id, name=_text, type=_text, location=_text, address=_text,
    latitude=T.DecimalType(16, 14), longitude=T.DecimalType(16, 14), email=_text, phone=_text, website=_text,
    verified=_text, dormitory=_flag, grants=_flag, directions=_text, description1=_text, description2=_text, description3=_text,
)
LINK = _struct(
    institution_id=_id, specialization_id=_id, cost=T.DecimalType(10, 2), duration=_text,
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
