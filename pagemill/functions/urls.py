"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def host(url: Column) -> Column:
    """The host in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def host_slug(url: Column) -> Column:
    """The host with underscores for dots; ``unknown`` without a host."""
    return F.translate(F.coalesce(host(url), F.lit("unknown")), ".", "_")


def canonical(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def is_excluded(url: Column, domains: list[str] | None = None) -> Column:
    """Whether one of domains occurs in the host, in any case; a URL without a host is not excluded."""
    found = F.lit(False)
    for domain in config.EXCLUDED_DOMAINS if domains is None else domains:
        found = found | F.contains(F.coalesce(host(url), F.lit("")), F.lit(domain.lower()))
    return found


def is_blocked_request(url: Column, resource: Column) -> Column:
    """Whether a request is not made: by its type, or by a word in its URL."""
    found = F.coalesce(resource.isin(config.BLOCKED_RESOURCES), F.lit(False))
    for word in config.BLOCKED_URLS:
        found = found | F.coalesce(F.contains(F.lower(url), F.lit(word)), F.lit(False))
    return found


def last_segment(url: Column) -> Column:
    """The last part of the percent-decoded path, without slashes at its end; null for an empty path."""
    decoded = F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B")))
    bare = F.regexp_replace(F.coalesce(decoded, path(url)), "/+$", "")
    return F.when(bare != "", F.element_at(F.split(bare, "/"), -1))


def model_in_url(url: Column) -> Column:
    """The last segment if it contains what looks like a model number, else null."""
    segment, found = last_segment(url), F.lit(False)
    for pattern in config.MODEL_PATTERNS:
        found = found | F.rlike(segment, F.lit(pattern))
    return F.when(found, segment)
