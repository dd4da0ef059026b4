"""Explicit schemas of stored tables; a table that lacks a required column is rebuilt."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
SYMBOL = T.StructType([T.StructField("name", _S), T.StructField("line_start", _I), T.StructField("line_end", _I)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILES = _struct(path=_S, mtime_ms=_L, content=_S)
CHUNKS = _struct(
    id=_S, path=_S, language=_S, chunk_start=_I, chunk_end=_I, line_start=_I, line_end=_I, text=_S, fts_text=_S,
    mtime_ms=_L, embedding=T.ArrayType(T.FloatType()), content_hash=_S, scope=T.ArrayType(_S),
    symbols=T.ArrayType(SYMBOL),
)
EDGES = _struct(
    kind=_S, conf=_S, from_path=_S, from_lines=_S, from_symbol=_S, to_path=_S, to_lines=_S, to_symbol=_S, ref_name=_S,
    candidates=T.ArrayType(_S), content_hash=_S, score=_D,
)
#: Edge columns that only live between extraction and resolution.
CALL_EXTRAS = _struct(
    is_method=T.BooleanType(), receiver=_S, receiver_type=_S, receiver_factory=_S, enclosing_class=_S, member_op=_S,
    local_target=_S,
)
LINKS = _struct(src=_S, dst=_S, kind=_S, conf=_S)
SYMBOLS = _struct(name=_S, path=_S, line_start=_I, line_end=_I, text=_S)
COMMITS = _struct(hash=_S, files=T.ArrayType(_S))
META = _struct(key=_S, value=_S)

CONFIDENCE_SEVERITY = {"resolved": 0, "inferred": 1, "dispatch": 2, "external": 3, "ambiguous": 4}


def missing(columns: list[str], required: T.StructType) -> list[str]:
    """Required columns that a stored table lacks (schema drift: rebuild if any)."""
    return [c for c in required.fieldNames() if c not in set(columns)]
