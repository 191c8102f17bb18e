"""Canonical JSON and content ids: a value's id is the SHA-256 of its canonical JSON."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(_plain(v) for v in value)
    if isinstance(value, datetime):
        utc = value.astimezone(timezone.utc) if value.tzinfo else value
        text = utc.isoformat()
        return text.replace("+00:00", "Z") if utc.tzinfo else text
    return value


def canonical_json(value) -> str:
    """JSON with sorted keys, no blanks, no escapes of non-ASCII characters and without null members."""
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def content_id(prefix: str, value) -> str:
    """prefix:sha256:<digest of the canonical JSON>."""
    return f"{prefix}:sha256:{hashlib.sha256(canonical_json(value).encode()).hexdigest()}"


def canonical_struct(**fields: Column) -> Column:
    """The canonical JSON of an object of strings, integers, booleans and arrays or structs of these (keys of inner structs sorted by the caller)."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def content_id_column(prefix: str, **fields: Column) -> Column:
    """content_id as a native expression, equal to the Python one for the types of canonical_struct."""
    return F.concat(F.lit(f"{prefix}:sha256:"), F.sha2(canonical_struct(**fields), 256))


def source_id_column(content: Column) -> Column:
    """The id of a source, by its bytes alone."""
    return F.concat(F.lit("source:sha256:"), F.sha2(content, 256))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A digest of a row over its columns in order; each value carries its length, so that neighbours cannot run together, and nulls differ from empty texts."""
    parts = [
        F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns or df.columns
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Parts of a row's digest that are summed apart: eight of 32 bits.
LANES = 8


def table_digest(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """name, n_rows, digest of a table whatever the order of its rows; repeated rows count.

    Row digests are added up lane by lane, and the sums hashed with the number of rows: partial sums are combined before
    the shuffle, so neither rows nor digests are ever gathered.
    """
    h = row_digest(df, columns)
    lane = lambda k: F.conv(F.substring("h", 1 + k * 8, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(lane(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(LANES)))
    return sums.select(F.lit(name).alias("name"), "n_rows", F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *(f"s{k}" for k in range(LANES))), 256).alias("digest"))
