"""Path expressions. Paths are byte strings; display columns are valid UTF-8."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(path: Column) -> Column:
    """Scalar key whose byte order is the component-wise order of paths.

    NUL cannot occur in a path and sorts below every other byte, so putting it
    in place of the separator makes ``a/b`` sort before ``a.txt``. The scalar
    form keeps aggregates and joins on plain BINARY.
    """
    return F.replace(path.cast("binary").cast("string"), F.lit("/"), F.lit("\x00")).cast("binary")


def path_of_key(key: Column) -> Column:
    """Inverse of :func:`order_key`."""
    return F.replace(key.cast("string"), F.lit("\x00"), F.lit("/"))


def display(path_bytes: Column) -> Column:
    return F.make_valid_utf8(path_bytes.cast("string"))


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def _prefix(root: str) -> str:
    return "/" if root == "/" else root.rstrip("/") + "/"


def relative_path(path: Column, root: str) -> Column:
    """Part of ``path`` below ``root``; NULL outside of it.

    A root that is itself the file yields the base name.
    """
    prefix = _prefix(root)
    return (
        F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30))
        .when(path == F.lit(root), base_name(path))
    )


def relative_bytes(path_bytes: Column, root: bytes) -> Column:
    """Byte form of :func:`relative_path`."""
    prefix = root.rstrip(b"/") + b"/"
    base_at = root.rfind(b"/") + 2
    return (
        F.when(F.startswith(path_bytes, F.lit(prefix)), F.substring(path_bytes, len(prefix) + 1, 1 << 30))
        .when(path_bytes == F.lit(root), F.substring(path_bytes, base_at, 1 << 30))
    )


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
