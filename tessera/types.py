"""Table schemas: a text form, and the Spark types they map to.

Spark has no unsigned types and no lists of fixed size. An unsigned column is the next wider signed type with field metadata
{"unsigned": bits}, a fixed-size list is an array with {"list_size": n}; writes check both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError

DELETED = "__deleted_flag"

SCALARS: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(), "string": T.StringType(), "utf8": T.StringType(), "large_string": T.StringType(),
}


def scalar_type(name: str) -> tuple[T.DataType, dict]:
    try:
        kind = SCALARS[name]
    except KeyError:
        raise EngineError(f"Unsupported type: {name}") from None
    return kind, {"unsigned": int(name[4:])} if name.startswith("uint") else {}


def _split(text: str) -> list[str]:
    """The parts between commas outside square brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if depth < 0:
            raise EngineError(f"Unbalanced brackets in schema: {text}")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    if depth:
        raise EngineError(f"Unbalanced brackets in schema: {text}")
    return [p.strip() for p in [*parts, text[start:]]]


def parse_schema(text: str) -> T.StructType:
    """'ID uint32 not null, Name String, Feature Fixed_Size_List[ 3, Float32 ]' as a StructType; everything is lower-cased."""
    fields = []
    for part in _split(text.lower()):
        found = re.fullmatch(r"(\S+)\s+(.+?)(\s+not\s+null)?", part, re.S)
        if not found:
            raise EngineError(f"Bad column definition: {part!r}")
        name, kind, required = found[1], found[2].strip(), bool(found[3])
        inner = re.fullmatch(r"(list|fixed_size_list)\s*\[(.*)\]", kind, re.S)
        if not inner:
            data, meta = scalar_type(kind)
        else:
            args = _split(inner[2])
            if len(args) != (1 if inner[1] == "list" else 2):
                raise EngineError(f"Bad list type: {kind}")
            if inner[1] == "list" and args[0] == "large_string":
                raise EngineError("Unsupported type: list of large_string")
            element, meta = scalar_type(args[-1])
            data = T.ArrayType(element)
            if inner[1] == "fixed_size_list":
                if not args[0].isdigit() or int(args[0]) < 1:
                    raise EngineError(f"Bad list size: {args[0]}")
                meta = meta | {"list_size": int(args[0])}
        fields.append(T.StructField(name, data, not required, meta))
    return T.StructType(fields)


def check_schema(schema: T.StructType) -> None:
    """Only scalars, strings and lists of them; no reserved or repeated names."""
    seen = set()
    for f in schema.fields:
        if f.name.startswith("__"):
            raise EngineError(f"Column names starting with '__' are reserved: {f.name}")
        if f.name in seen:
            raise EngineError(f"Column '{f.name}' is declared twice.")
        seen.add(f.name)
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if type(kind) not in {type(t) for t in SCALARS.values()} or (isinstance(kind, T.DecimalType) and f.metadata.get("unsigned") != 64):
            raise EngineError(f"Wrong Schema. Column '{f.name}' has an unsupported type: {f.dataType.simpleString()}")


def violations(schema: T.StructType) -> Column:
    """For a row of the schema: the first rule it breaks, or null."""
    rules = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        array = isinstance(f.dataType, T.ArrayType)
        if not f.nullable:
            rules.append((c.isNull(), f"column '{f.name}' is not null"))
        if size := f.metadata.get("list_size"):
            rules.append((c.isNotNull() & (F.size(c) != size), f"column '{f.name}' has lists of {size}"))
        if bits := f.metadata.get("unsigned"):
            outside = lambda x, bits=bits: (x < 0) | (x > F.lit(2**bits - 1).cast("decimal(20,0)"))
            wide = lambda x: x.cast("decimal(20,0)")
            rules.append((F.exists(F.transform(c, wide), lambda x, o=outside: o(x)) if array else outside(wide(c)), f"column '{f.name}' is an unsigned integer of {bits} bits"))
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(what)) for broken, what in rules], F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def extended(schema: T.StructType) -> T.StructType:
    """The schema with the hidden deletion flag last."""
    return T.StructType([*schema.fields, T.StructField(DELETED, T.BooleanType(), False)])
