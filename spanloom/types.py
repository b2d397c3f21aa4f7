"""Record types and the vector guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.errors import DialectError


def record(spec: str) -> T.StructType:
    """``"index:int title:string"`` as a struct."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in (x.split(":") for x in spec.split())])


CHAPTER = "index:int title:string start_t:double end_t:double"
CUE = "index:int track:string text:string start_t:double end_t:double"
ATTACHMENT = "index:int filename:string mimetype:string"
VIDEO = "index:int codec:string width:int height:int fps:string bitrate:bigint duration:double color_transfer:string"
AUDIO = "index:int codec:string channels:int channel_layout:string sample_rate:int bitrate:bigint duration:double"


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType)


def refuse_vectors(df: DataFrame, names: list[str], use: str) -> None:
    """Vectors have no order, no equality and no text form."""
    for name in names:
        if name in df.columns and is_vector(df.schema[name].dataType):
            raise DialectError("UDF_ARG_TYPE", f"a vector cannot be {use}: {name}")
