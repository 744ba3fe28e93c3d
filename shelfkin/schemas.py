"""Declared schemas.  Landed data is never read by inference."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# `title` and `tags` come in two shapes (object or array, or a plain string), which only a
# VARIANT keeps apart; `endDate` is a map so that a missing key differs from a null one.
RAW_ITEM = _struct(
    id=T.LongType(),
    title=T.VariantType(),
    tags=T.VariantType(),
    genres=T.ArrayType(T.StringType()),
    popularity=T.LongType(),
    chapters=T.LongType(),
    volumes=T.LongType(),
    averageScore=T.LongType(),
    meanScore=T.LongType(),
    favourites=T.LongType(),
    startDate=_struct(month=T.LongType(), year=T.LongType()),
    endDate=T.MapType(T.StringType(), T.LongType()),
    isAdult=T.BooleanType(),
    description=T.StringType(),
)

# Read as text, so that coercion follows our rules and not the JSON reader's.
RAW_INTERACTION = _struct(
    userId=T.StringType(),
    status=T.StringType(),
    score=T.StringType(),
    progress=T.StringType(),
    mediaId=T.StringType(),
    createdAt=T.StringType(),
)

# As landed, item numbers may be written as whole numbers or as doubles.
_COUNTS = ("popularity", "chapters", "volumes", "averageScore", "meanScore", "favourites")
LANDED_ITEM = _struct(**{f.name: T.DoubleType() if f.name in _COUNTS else f.dataType for f in RAW_ITEM})

_PAGE_INFO = _struct(hasNextPage=T.BooleanType())

ITEM_RESPONSE = _struct(
    errors=T.VariantType(),
    data=_struct(Page=_struct(media=T.ArrayType(LANDED_ITEM), pageInfo=_PAGE_INFO)),
    malformed=T.StringType(),
)

INTERACTION_RESPONSE = _struct(
    userId=T.LongType(),
    page=T.LongType(),
    errors=T.VariantType(),
    data=_struct(Page=_struct(mediaList=T.ArrayType(RAW_INTERACTION), pageInfo=_PAGE_INFO)),
    malformed=T.StringType(),
)
