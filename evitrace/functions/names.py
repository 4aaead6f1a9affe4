"""File-safe names of entries and the identity a path proves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions.digest import digest

NAME_BUDGET = 100
# Device names no file may carry.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)])
PLAIN = r"^[A-Za-z0-9_-]{1,100}$"


@F.pandas_udf(T.StringType())
def _percent_encode(names: pd.Series) -> pd.Series:
    import unicodedata

    keep = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    return names.map(lambda n: None if n is None else "".join(
        c if c in keep else "".join(f"%{b:02X}" for b in c.encode()) for c in unicodedata.normalize("NFKC", n)
    ))


def safe_name(full_name: Column, identity: Column) -> Column:
    """A name made of plain characters; what had to be cut or is reserved gets a digest suffix.

    Plain names stay in the JVM; only the others are encoded byte by byte.
    """
    plain = full_name.rlike(r"^[A-Za-z0-9_-]*$")
    encoded = F.coalesce(_percent_encode(F.when(~plain, full_name)), full_name)
    # The digest is over the JSON string, quotes included.
    mark = F.substring(digest(F.concat(F.lit('"'), identity, F.lit('"'))), 8, 8)
    cut = F.regexp_replace(F.substring(encoded, 1, NAME_BUDGET), "%[0-9A-F]?$", "")
    stem = F.when(F.char_length(encoded) > NAME_BUDGET, F.concat_ws("-", cut, mark)).otherwise(encoded)
    reserved = F.upper(F.substring_index(stem, "-", 1)).isin(*RESERVED)
    return F.when(reserved, F.concat_ws("-", stem, mark)).otherwise(stem)


def identity_of_path(path: Column) -> Column:
    """``family/Type/ns/Name.md`` back to its identity, or null when the path cannot prove it."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.get(parts, F.lit(3)), r"\.md$", "")
    proven = (F.size(parts) == 4) & path.endswith(".md") & name.rlike(PLAIN) & ~F.upper(F.substring_index(name, "-", 1)).isin(*RESERVED)
    return F.when(proven, F.concat_ws(":", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), name))
