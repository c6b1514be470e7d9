"""URL expressions: authority, host name, root domain, joins, parameter removal.

Native (JVM) expressions cover the common shapes; the general cases run
through Arrow-batched pandas UDFs over the standard library.
"""
from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .. import constants as C

SCHEME_AUTHORITY = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def netloc(url: Column) -> Column:
    """Authority part as written (userinfo and port kept, case kept); '' if none."""
    return F.regexp_extract(url, AUTHORITY, 1)


def hostname(url: Column) -> Column:
    """Host without userinfo/port, lower-cased; NULL when empty."""
    h = F.regexp_extract(netloc(url), "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1)
    h = F.lower(F.regexp_replace(h, "^\\[|\\]$", ""))
    return F.when(h != "", h)


def root_domain(host: Column) -> Column:
    """Last two dot labels when there are more than two, else the host."""
    parts = F.split(host, "\\.")
    return F.when(F.size(parts) > 2,
                  F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


# ------------------------------------------------------------ relative links
def _join_one(base: str | None, ref: str | None) -> str | None:
    if base is None or ref is None:
        return None
    return urljoin(base, ref)


@pandas_udf(StringType())
def urljoin_udf(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([_join_one(b, r) for b, r in zip(base, ref)], dtype=object)


def resolve_link(base: Column, href: Column) -> Column:
    """``urljoin(base, href)``; root-relative hrefs on http(s) bases are joined JVM-side."""
    fast = (base.rlike("^https?://")
            & href.rlike("^/([^/]|$)")
            & ~href.rlike("(^|/)\\.\\.?(/|$|[?#])")
            & ~href.rlike("[\\x00-\\x20]"))
    # the UDF sees all rows of the plan, so the fast ones come to it as NULL
    return F.when(fast, F.concat(F.regexp_extract(base, SCHEME_AUTHORITY, 1), href)) \
            .otherwise(urljoin_udf(F.when(~fast, base), F.when(~fast, href)))


# ------------------------------------------------------- query parameter drop
def drop_query_param(url: str | None, param: str = C.ESCAPED_FRAGMENT_PARAM) -> str | None:
    """Remove ``param`` from the query when it carries a non-blank value.

    Query parsing follows ``parse_qs``: blank values are not parsed, so a
    blank-only ``param`` leaves the URL as it is; when the parameter is
    removed the rest is re-encoded grouped by key in first-seen order, and
    blank parameters disappear with it.  The fragment is kept.
    """
    if url is None:
        return None
    parts = urlsplit(url)
    pairs = parse_qsl(parts.query)
    if all(k != param for k, _ in pairs):
        return url
    grouped: dict[str, list[str]] = {}
    for k, v in pairs:
        if k != param:
            grouped.setdefault(k, []).append(v)
    query = urlencode([(k, v) for k, vs in grouped.items() for v in vs])
    return urlunsplit(parts._replace(query=query))


def drop_query_param_col(url: Column, param: str = C.ESCAPED_FRAGMENT_PARAM) -> Column:
    @pandas_udf(StringType())
    def _drop(u: pd.Series) -> pd.Series:
        return pd.Series([drop_query_param(x, param) for x in u], dtype=object)
    # URLs that cannot carry the parameter are returned unchanged JVM-side
    # (a percent-encoded key could decode to it, so those go to Python too)
    mentions = (F.instr(url, param) > 0) | (F.instr(url, "%") > 0)
    return F.when(mentions, _drop(F.when(mentions, url))).otherwise(url)
