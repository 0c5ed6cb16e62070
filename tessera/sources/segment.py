"""Segmentation: how rows are dealt to partitions, and the ids of segments."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, EngineError

BUCKET = "__bucket"
DEFAULT_ID = "_default_"
VERSION = "v1"
COMPOSITIONS = {"single": "single", "hierarchical": "hier", "composite": "comp"}


@dataclass(frozen=True)
class Segmentation:
    kind: str = ""
    keys: tuple[str, ...] = ()
    composition: str = "single"
    buckets: int = 0

    @classmethod
    def parse(cls, text: str | dict | None, schema: T.StructType) -> Segmentation:
        """From JSON: segment_type, segment_keys, segment_key_composition_type, num_buckets."""
        if not text:
            return cls()
        info = json.loads(text) if isinstance(text, str) else text
        unknown = set(info) - {"segment_type", "segment_keys", "segment_key_composition_type", "num_buckets", "version"}
        if unknown:
            raise EngineError(f"Unknown segmentation keys: {sorted(unknown)}")
        kind, composition = info.get("segment_type"), info.get("segment_key_composition_type", "single")
        keys = info.get("segment_keys") or ()
        keys = tuple(keys.split(",")) if isinstance(keys, str) else tuple(keys)
        if kind not in ("value", "hash"):
            raise EngineError(f"segment_type must be value or hash, not {kind!r}")
        if not keys or len(set(keys)) != len(keys):
            raise EngineError("segment_keys must name columns, each once")
        if composition not in COMPOSITIONS or (kind == "hash" and composition != "single"):
            raise EngineError(f"segment_key_composition_type can't be {composition!r} here")
        if (composition == "single") != (len(keys) == 1):
            raise EngineError(f"A {composition} segmentation can't have {len(keys)} keys")
        fields = {f.name: f for f in schema.fields}
        for k in keys:
            if k not in fields:
                raise ColumnNotFound(k)
            if isinstance(fields[k].dataType, T.ArrayType):
                raise EngineError(f"Segment key '{k}' is a list")
            if kind == "value" and fields[k].nullable:
                raise EngineError(f"Segment key '{k}' must be not null")
        buckets = int(info.get("num_buckets", 0))
        if (kind == "hash") != (buckets > 0):
            raise EngineError("num_buckets must be positive for hash segmentation, and is for it only")
        return cls(kind, keys, composition, buckets)

    def json(self) -> dict | None:
        out = {"segment_type": self.kind, "segment_keys": list(self.keys), "segment_key_composition_type": self.composition}
        return None if not self.kind else out | ({"num_buckets": self.buckets} if self.buckets else {})

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def columns(self) -> list[str]:
        """The partition columns."""
        return [BUCKET] if self.kind == "hash" else list(self.keys)

    def id(self) -> Column:
        """The segment id of a row that has its partition columns."""
        if not self.kind:
            return F.lit(DEFAULT_ID)
        keys = "+".join(self.keys)
        if self.kind == "hash":
            return F.concat(F.lit(f"{VERSION}::hash::single::{keys}::"), F.col(BUCKET).cast("string"), F.lit(f"::{self.buckets}::"))
        values = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in self.keys]))
        return F.concat(F.lit(f"{VERSION}::value::{COMPOSITIONS[self.composition]}::{keys}::"), values, F.lit("::::"))

    def pruned(self, values: dict[str, list[object]], schema: T.StructType) -> Column | None:
        """For hash segmentation: the buckets that rows with these key values are in. Value keys are partition columns, which Spark prunes by itself."""
        if self.kind != "hash" or self.keys[0] not in values:
            return None
        kind = schema[self.keys[0]].dataType
        found = [self.bucket(F.lit(v).cast(kind)) for v in values[self.keys[0]]]
        return F.col(BUCKET).isin(*found) if found else F.lit(False)


def value_id(composition: str, keys: list[str], values: list[str]) -> str:
    return f"{VERSION}::value::{COMPOSITIONS[composition]}::{'+'.join(keys)}::{json.dumps(values, separators=(',', ':'), ensure_ascii=False)}::::"


def hash_id(key: str, text: str, buckets: int) -> str:
    """The id by XXH3 of the key's text; placement in our own files goes by Spark's hash, which changes no result."""
    import xxhash

    return f"{VERSION}::hash::single::{key}::{xxhash.xxh3_64_intdigest(text.encode()) % buckets}::{buckets}::"


def parse_id(text: str) -> dict:
    """The parts of a segment id. Values are JSON, so '::' within one doesn't end it."""
    if text == DEFAULT_ID:
        return {"type": "default", "keys": [], "values": []}
    head = text.split("::", 4)
    if len(head) != 5 or head[0] != VERSION or head[1] not in ("value", "hash"):
        raise EngineError(f"Bad segment id: {text!r}")
    keys = head[3].split("+")
    if head[1] == "hash":
        bucket, buckets, *_ = [*head[4].split("::"), ""]
        if not (bucket.isdigit() and buckets.isdigit()):
            raise EngineError(f"Bad segment id: {text!r}")
        return {"type": "hash", "composition": "single", "keys": keys, "bucket": int(bucket), "buckets": int(buckets)}
    try:
        values, end = json.JSONDecoder().raw_decode(head[4])
    except ValueError:
        raise EngineError(f"Bad segment id: {text!r}") from None
    if head[4][end:] != "::::" or len(values) != len(keys):
        raise EngineError(f"Bad segment id: {text!r}")
    return {"type": "value", "composition": {v: k for k, v in COMPOSITIONS.items()}[head[2]], "keys": keys, "values": values}
