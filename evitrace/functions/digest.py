"""Canonical JSON and digests, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """``sha256:<hex>`` of a UTF-8 string."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("string"), 256))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, nulls kept and UTF-8 unescaped.

    Nested structs must already carry their fields in sorted order; maps go through
    :func:`sorted_map` first, because ``to_json`` keeps insertion order.
    """
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_digest(fields: dict[str, Column]) -> Column:
    return digest(canonical_json(fields))


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def stable_id(prefix: str, identity: Column, discriminator: Column) -> Column:
    """``PREFIX-SLUG-DIGEST``, at most 80 characters."""
    slug = F.btrim(F.regexp_replace(F.upper(identity), "[^A-Z0-9]+", "-"), F.lit("-"))
    slug = F.when(slug == "", F.lit("ITEM")).otherwise(slug)
    suffix = F.upper(F.substring(F.sha2(F.concat_ws("|", identity, discriminator), 256), 1, 10))
    room = 80 - len(prefix) - 10 - 2
    return F.concat_ws("-", F.lit(prefix), F.rtrim(F.substring(slug, 1, room), F.lit("-")), suffix)
