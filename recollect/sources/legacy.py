"""Moving the first table layout (text, tags, embedding blob) to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import iso_millis
from recollect.functions.vectors import decode_float32
from recollect.schema import DEFAULT_PROJECT, KIND_MANUAL, MEMORIES, SCHEMA_VERSION
from recollect.session import Scratch
from recollect.sources.store import MemoryStore

_CURRENT_ONLY = {"project", "kind", "content_hash", "updated_at"}


def decode_tags(raw: Column) -> Column:
    """The strings of a JSON array; anything else decodes to no tags."""
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def encode_tags(tags: Column) -> Column:
    return F.to_json(tags)


def is_current(old: DataFrame) -> bool:
    return _CURRENT_ONLY <= set(old.columns)


def upgrade(old: DataFrame) -> DataFrame:
    """Old rows in the current layout, ids unchanged. A table already current passes through."""
    have = set(old.columns)
    if is_current(old):
        return old.select(*MEMORIES.fieldNames())
    if not {"text", "embedding"} <= have:
        raise ValueError("not a memories table: text or embedding is missing")
    now = F.date_trunc("MILLISECOND", F.current_timestamp())
    created = F.coalesce(F.col("created_at").cast("timestamp"), now) if "created_at" in have else now
    vector = old.schema["embedding"].dataType.typeName()
    columns = {
        "id": F.col("id").cast("long"),
        "project": F.lit(DEFAULT_PROJECT),
        "kind": F.lit(KIND_MANUAL),
        "text": F.col("text"),
        "tags": decode_tags(F.col("tags")) if "tags" in have else F.array().cast("array<string>"),
        "embedding": decode_float32(F.col("embedding")) if vector == "binary" else F.col("embedding"),
        "created_at": created,
        "updated_at": created,
    }
    return old.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORIES.fields]
    )


def migrate(store: MemoryStore, old: DataFrame) -> int:
    """Load an old table into an empty store; the number of rows moved."""
    if store.projects():
        return 0
    with Scratch(store.spark) as scratch:
        return _load(store, old, scratch.keep(upgrade(old)))


def _load(store: MemoryStore, old: DataFrame, rows: DataFrame) -> int:
    n_old, n_new = old.count(), rows.count()
    if n_old != n_new:
        raise RuntimeError(f"row counts differ: {n_new} of {n_old}")
    next_id, at = rows.agg(F.coalesce(F.max("id"), F.lit(0)) + 1, iso_millis(F.current_timestamp())).first()
    meta = {"schema_version": str(SCHEMA_VERSION)}
    if not is_current(old):
        meta |= {"migrated_from_version": "1", "migrated_at": at}
    store.load(rows, next_id, meta)
    return n_new
