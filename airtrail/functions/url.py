"""URL and host columns. All are plain Spark expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

# Device words looked for in a user agent, first match wins (case-sensitive).
MOBILE_WORDS = (
    r"android|(bb\d+|meego).+mobile|avantgo|bada\/|blackberry|blazer|compal|docomo|dolfin|dolphin|elaine|fennec|"
    r"hiptop|iemobile|(hpw|web)os|htc( touch)?|ip(hone|od|ad)|iris|j2me|kindle( fire)?|lge |maemo|midp|minimo|mmp|"
    r"netfront|nokia|opera m(ob|in)i|palm( os)?|phone|p(ixi|re)\/|plucker|playstation|pocket|portalmmm|psp|"
    r"series(4|6)0|symbian|silk-accelerated|skyfire|sonyericsson|treo|tablet|touch(pad)?|up\.(browser|link)|"
    r"vodafone|wap|webos|windows (ce|phone)|wireless|xda|xiino|zune"
)

class Suffixes(NamedTuple):
    """Public suffix rules: plain suffixes, parents of wildcard rules (``*.ck``), hosts that exception rules (``!www.ck``) take out."""

    plain: tuple[str, ...]
    wildcards: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()



def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_params(url: Column) -> Column:
    """Address without protocol and without everything from ``?`` or ``&``."""
    return F.regexp_replace(url, r"(?s)^(?:\w+://)?([^\?&]+).*$", "$1")


def strip_params_keep_proto(url: Column) -> Column:
    """Address without parameters, protocol kept."""
    return F.regexp_replace(url, r"(?s)^((?:\w+://)?[^\?&]+).*$", "$1")


def strip_proto(url: Column) -> Column:
    """Address without ``http://`` (or the broken form ``http//``)."""
    return F.regexp_replace(url, r"^\w+:?//", "")


def has_proto(url: Column) -> Column:
    """True when the address starts with a protocol; null counts as false."""
    return F.coalesce(url.rlike(r"^(\w+:?//).*"), F.lit(False))


def strip_url(url: Column) -> Column:
    """Address without protocol and parameters."""
    return strip_proto(strip_params(url))


def combine_url(host: Column, uri: Column) -> Column:
    """Full address from the Host and request-line headers."""
    return F.when(has_proto(uri), uri).otherwise(F.concat(host, uri))


def entry_url(host: Column, uri: Column) -> Column:
    """Address of a log entry: null without host or path, protocol removed when the path holds a full address."""
    return F.when(host.isNull() | uri.isNull(), F.lit(None)).when(
        uri.startswith("http"), strip_proto(uri)
    ).otherwise(F.concat(host, uri))


def url_host(url: Column) -> Column:
    """Host part without port, path and parameters."""
    return F.nullif(F.regexp_extract(url, r"^(?:\w+:?//)?([^:\/\?&]+)", 1), F.lit(""))


def url_params(url: Column) -> Column:
    """Query parameters as a map; a repeated name keeps its last value."""
    query = F.regexp_extract(url, r"^(?:\w+://)?(?:[^\?&]+)(\?.*)?$", 1)
    pairs = F.regexp_extract_all(query, F.lit(r"([^?=&]+=[^?&=]+)"), F.lit(1))
    # from the last pair on, the first of each name stays
    back = F.reverse(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("n"), F.substring_index(p, "=", -1).alias("v"))))
    names = F.transform(back, lambda e: e["n"])
    last = F.filter(back, lambda e, i: F.array_position(names, e["n"]) == i + 1)
    built = F.map_from_entries(F.reverse(last))
    return F.when(url.isNotNull(), built)


def registered_domain(url: Column, suffixes: Suffixes) -> Column:
    """Longest known public suffix plus one label; the host itself when there is none.

    The rules (``read_lookup(kind="suffixes")``) become hash sets in the expression, so the cost does not grow with their number; for a table of rules
    see ``operators.lookups.add_domain``.
    """
    plain, wildcards, exceptions = suffixes
    host = url_host(url)
    low = F.lower(host)
    deepest = max([1, *(s.count(".") + 1 for s in plain), *(w.count(".") + 2 for w in wildcards)])
    out = host
    for n in range(1, deepest + 1):
        tail = F.substring_index(low, ".", -n)
        known = tail.isin(*plain)
        if wildcards and n > 1:
            parent = F.substring_index(low, ".", 1 - n)
            known = known | (parent.isin(*wildcards) & (tail != parent))
        if exceptions:
            known = known & ~tail.isin(*exceptions)
        out = F.when(known, F.substring_index(host, ".", -n - 1)).otherwise(out)
    return out


def url_equal(a: Column, b: Column, loose: bool = False) -> Column:
    """Same address without protocol; ``loose`` also ignores parameters."""
    if loose:
        return strip_proto(strip_params_keep_proto(a)) == strip_proto(strip_params_keep_proto(b))
    return strip_proto(a) == strip_proto(b)


def url_in(url: Column, urls: Column) -> Column:
    """True when the address occurs in an array of addresses, protocols ignored."""
    return F.exists(urls, lambda u: strip_proto(u) == strip_proto(url))


def mobile_type(agent: Column) -> Column:
    """Device word found in a user agent, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(agent, MOBILE_WORDS, 0), F.lit("")), F.lit("unknown"))
