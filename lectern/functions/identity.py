"""Derived ids and hashes, composed from built-in functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the root of all name spaces; one for each kind of id is chained from it.
ROOT = uuid.UUID("6f4b3d2a-1c8e-5f7a-9b0d-3e2a1c8e5f7a")
SPACES = {kind: uuid.uuid5(ROOT, kind) for kind in ("source", "document", "version", "chunk")}


def uuid5(space: uuid.UUID, name: Column) -> Column:
    """Name-based UUID: SHA-1 of name space and name with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    joined = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )
    return F.when(name.isNotNull(), joined)


def derived_id(kind: str, *parts: Column) -> Column:
    """Id of a source, document, version or chunk from its natural key; null if a part is null."""
    name = F.concat(*[x for p in parts for x in (F.lit("|"), p.cast("string"))][1:])
    return uuid5(SPACES[kind], name)


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def object_key(tenant: Column, document: Column, digest: Column, suffix: Column) -> Column:
    """Storage key without any part a caller controls."""
    clean = F.substring(F.regexp_replace(suffix, r"[^\p{L}\p{N}.]", ""), 1, 16)
    dotted = F.when((clean != "") & ~clean.startswith("."), F.concat(F.lit("."), clean)).otherwise(clean)
    safe = F.substring(F.regexp_replace(tenant, r"[^\p{L}\p{N}_-]", ""), 1, 64)
    return F.concat(F.when(safe == "", "default").otherwise(safe), F.lit("/"), document, F.lit("/"), digest, dotted)


def backoff_seconds(attempts: Column, base: float, cap: float) -> Column:
    """Doubles with every attempt, capped; the first failure waits ``base``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(cap))


def config_hash(sentences: int, overlap: int, k: int, window: int, normalizer: str) -> str:
    """Names the parameters that change what is stored for reuse detection."""
    import hashlib

    return hashlib.sha256(f"v2|{sentences}|{overlap}|{k}|{window}|{normalizer}".encode()).hexdigest()[:32]
