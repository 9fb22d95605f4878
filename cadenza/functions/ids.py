"""Identifiers and hashes from built-in digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import posix_path

#: Namespace of URLs in name-based UUIDs. Fixed value.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID of version 5; a null name gives null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.when(name.isNotNull(), F.concat_ws("-", *parts))


def job_hash(*parts: Column, path: int | None = None) -> Column:
    """SHA-256 of the parts joined by bars; the part numbered `path` is brought to one form first."""
    return F.sha2(F.concat_ws("|", *[posix_path(p) if i == path else p.cast("string") for i, p in enumerate(parts)]), 256)


def operation_id(kind: Column, key: Column, members: Column) -> Column:
    """kind-key-digest over the sorted members: equal operations get equal ids."""
    text = F.concat_ws("|", kind, key.cast("string"), F.array_join(F.transform(F.array_sort(members), lambda x: x.cast("string")), ","))
    return F.concat_ws("-", kind, key.cast("string"), F.substring(F.sha2(text, 256), 1, 16))


def content_digest(fields: dict[str, Column], numbers: dict[str, Column], digits: int = 2) -> Column:
    """First 16 digits of the SHA-256 of JSON with sorted names, its numbers with so many decimals; nulls are left out."""
    cols = {**{n: c.cast("string") for n, c in fields.items()}, **{n: F.format_string(f"%.{digits}f", c.cast("double")) for n, c in numbers.items()}}
    return F.substring(F.sha2(F.to_json(F.struct(*[cols[n].alias(n) for n in sorted(cols)])), 256), 1, 16)


def sampled_digest(values: Column, stride: int, levels: int = 256) -> Column:
    """SHA-256 of every stride-th value as a whole number of `levels` steps from 0 to 1, so that small changes elsewhere don't matter."""
    picked = F.filter(values, lambda x, i: i % stride == 0)
    return F.sha2(F.array_join(F.transform(picked, lambda x: F.floor(x.cast("double") * levels).cast("string")), ","), 256)
