"""Content and path digests (SHA-256, 32-byte BINARY)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(payload: Column) -> Column:
    """Digest of all bytes of a payload column; NULL for a NULL payload."""
    return F.unhex(F.sha2(payload.cast("binary"), 256))


def path_digest(path_bytes: Column) -> Column:
    """Fixed-width join key of a path, taken over its raw bytes."""
    return F.unhex(F.sha2(path_bytes.cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))
