"""The fact tables. Lines and places are longs; only `symbols.value` is nullable.

`pos` is the offset of a fact in its file: (file, pos) is the canonical order wherever a
query takes the first of several.
"""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = T.ArrayType(T.StringType(), False)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name == "value") for name, kind in fields])


S, L, B = T.StringType(), T.LongType(), T.BooleanType()

FILES = _table(("path", S), ("content", S), ("content_hash", S), ("mtime", T.TimestampType()))
FUNCTIONS = _table(("name", S), ("file", S), ("line", L), ("source", S), ("conditions", _NAMES), ("is_static", B), ("pos", L))
CALLS = _table(("caller", S), ("callee", S), ("line", L), ("caller_file", S), ("pos", L))
SYMBOLS = _table(("name", S), ("kind", S), ("conditions", _NAMES), ("value", S), ("file", S), ("line", L), ("pos", L))
TYPES = _table(("name", S), ("kind", S), ("definition", S), ("conditions", _NAMES), ("file", S), ("line", L), ("pos", L))
GLOBALS = _table(("name", S), ("decl", S), ("conditions", _NAMES), ("is_static", B), ("file", S), ("line", L), ("pos", L))

#: One row a fact, as the extractor emits it; `fact` says which table it belongs to.
FACTS = T.StructType(
    [
        T.StructField("fact", S, False),
        T.StructField("file", S, False),
        T.StructField("content_hash", S, True),
        T.StructField("name", S, False),
        T.StructField("kind", S, True),
        T.StructField("line", L, False),
        T.StructField("pos", L, False),
        T.StructField("text", S, True),
        T.StructField("flag", B, True),
        T.StructField("conditions", _NAMES, True),
    ]
)
