"""References resolved against http and https URLs, dot segments and all, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .web import host, origin

#: What an event without any URL is given.
DEFAULT_URL = "https://site.example"


def _path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """An absolute path with its `.` and `..` segments followed; more `..` than there are folders stop at the root."""
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    step = lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), step)
    at_folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(at_folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolve(reference: Column, base: Column) -> Column:
    """The URL that a reference names on a page: absolute, //host, /path, ?query, #fragment or relative. Null where the base, if it is needed, is no http or https URL."""
    reference = F.coalesce(reference, F.lit(""))
    root = F.when(F.length(host(base)) > 0, origin(base))
    scheme = F.regexp_extract(base, "^([a-zA-Z]+)://", 1)
    absolute = F.when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference)).otherwise(reference)
    with_tail = lambda r, path, of: F.concat(r, without_dots(F.when(path == "", "/").otherwise(path)), F.regexp_extract(of, "^(?:[a-zA-Z]+://)?[^?#]*((?s).*)$", 1))
    own_path, base_path = F.regexp_extract(reference, "^[^?#]*", 0), F.when(_path(base) == "", "/").otherwise(_path(base))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    merged = F.concat(F.regexp_extract(base_path, "^(.*/)", 1), own_path)
    return (
        F.when(reference.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & (F.length(host(reference)) == 0), reference)
        .when((F.length(host(absolute)) > 0), with_tail(origin(absolute), _path(absolute), absolute))
        .when(reference.startswith("/"), with_tail(root, own_path, reference))
        .when(reference == "", F.concat(root, without_dots(base_path), query))
        .when(reference.startswith("?"), F.concat(root, without_dots(base_path), reference))
        .when(reference.startswith("#"), F.concat(root, without_dots(base_path), query, reference))
        .otherwise(with_tail(root, merged, reference))
    )


def event_url(path: Column, base: Column, source_url: Column) -> Column:
    """An event's URL: its path on its origin, joined as text where that is no URL; else the origin; else its path on the source's URL, or that; else the default."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return (
        F.when(has(base) & has(path), F.coalesce(resolve(path, base), F.concat(base, path))).when(has(base), base)
        .when(has(source_url), F.coalesce(resolve(F.coalesce(path, F.lit("/")), source_url), source_url)).otherwise(DEFAULT_URL)
    )
