"""Hierarchical topic paths such as ``/english/law/early``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class TopicError(ValueError):
    """A string that isn't a topic path."""


def checked(path: str) -> str:
    """``path`` without a trailing slash; raises ``TopicError`` unless it starts with one."""
    if not path.startswith("/"):
        raise TopicError(f"a topic path starts with a slash: {path!r}")
    return path.rstrip("/")


def tidy(topics: Column) -> Column:
    """A stored value as a path: one leading slash, none at the end; null becomes the root."""
    return F.concat(F.lit("/"), F.trim(F.coalesce(topics, F.lit("")), F.lit("/")))


def under(topics: Column, path: str) -> Column:
    """Whether ``topics`` is ``path`` or lies under it."""
    root = checked(path)
    return topics.isNotNull() if not root else (topics == root) | topics.startswith(root + "/")


def under_any(topics: Column, paths: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [under(topics, p) for p in paths])


def child(topics: Column, prefix: str) -> Column:
    """The child of ``prefix`` on the way to ``topics``; null for what isn't below it."""
    root = checked(prefix)
    below = F.substring(topics, len(root) + 2, 1 << 30)
    name = F.split_part(below, F.lit("/"), F.lit(1))
    return F.when(topics.startswith(root + "/") & (name != ""), F.concat(F.lit(root + "/"), name))


def ancestors(topics: Column) -> Column:
    """Every path from the first level down to ``topics`` itself."""
    parts = F.filter(F.split(topics, "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))
