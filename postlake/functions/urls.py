"""Resolving a reference against the address of its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _remove_dots(path: Column) -> Column:
    """Path with `.` and `..` segments resolved."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)

    def step(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return (
            F.when(segment == ".", done)
            .when(segment == "..", shorter)
            .otherwise(F.array_append(done, segment))
        )

    # The first segment is the empty one before the leading slash: never removed.
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.slice(segments, F.lit(1), F.lit(1)), step
    )
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    dotted = path.contains("/.")
    return F.when(dotted, F.array_join(closed, "/")).otherwise(path)


def url_join(base: Column, reference: Column) -> Column:
    """Absolute form of `reference` found on the page at `base`."""
    ref = F.regexp_replace(
        F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", ""
    )
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(base, r"^[^:/?#]+://([^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    origin = F.concat(scheme, F.lit("://"), host)

    def resolve(r: Column) -> Column:
        r_path = F.regexp_extract(r, r"^([^?#]*)", 1)
        r_rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
        from_folder = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), r_path)
        return (
            F.when(r == "", base)
            .when(r.rlike(_SCHEME), r)
            .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, _remove_dots(r_path), r_rest))
            .when(r.startswith("?"), F.concat(bare, r))
            .when(r.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), r))
            .otherwise(F.concat(origin, _remove_dots(from_folder), r_rest))
        )

    return let(ref, resolve)
