"""URL columns: canonical form, cache key, host, chunk id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# scheme, authority, path, query; the fragment is left out.
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def authority(col: Column | str) -> Column:
    """User info, host and port as written."""
    return F.regexp_extract(_c(col), _SPLIT, 2)


def host(col: Column | str) -> Column:
    """Lower-cased host without user info and port; IPv6 keeps its brackets."""
    at = F.regexp_replace(authority(col), r"^.*@", "")
    return F.lower(F.regexp_replace(at, r":[0-9]*$", ""))


def path(col: Column | str) -> Column:
    """The path, ``/`` where the URL has none."""
    p = F.regexp_extract(_c(col), _SPLIT, 3)
    return F.when(p == "", "/").otherwise(p)


def path_query(col: Column | str) -> Column:
    """Path and query: what robots rules are matched against."""
    q = F.regexp_extract(_c(col), _SPLIT, 4)
    return F.concat(path(col), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def scheme(col: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(col), _SPLIT, 1))


def normalize_url(col: Column | str) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, empty
    path made ``/``; user info, path and query stay as written."""
    auth = authority(col)
    user = F.regexp_extract(auth, r"^(.*)@", 1)
    user = F.regexp_replace(user, ":$", "")
    port = F.regexp_replace(F.regexp_extract(F.regexp_replace(auth, r"^.*@", ""), r":([0-9]+)$", 1), "^0+(?=.)", "")
    proto = scheme(col)
    default = F.when(proto == "http", "80").when(proto == "https", "443").otherwise("")
    return F.concat(
        F.when(proto == "", "").otherwise(F.concat(proto, F.lit(":"))),
        F.when((auth == "") & (proto == ""), "").otherwise("//"),
        F.when((user == "") | user.startswith(":"), "").otherwise(F.concat(user, F.lit("@"))),
        host(col),
        F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)),
        path_query(col),
    )


def cache_key(col: Column | str) -> Column:
    """SHA-256 of the canonical URL."""
    return F.sha2(normalize_url(col), 256)


def chunk_id(url: Column | str, position: Column | str) -> Column:
    """Same document, same position, same id: 16 hex digits of a SHA-256."""
    joined = F.concat_ws("|", _c(url), _c(position).cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 16)
