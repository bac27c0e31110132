"""What no built-in expression computes exactly: relative URLs, text variants, address literals.

All are Arrow-batched; they are used only where a plan needs them, after filters.
"""

from __future__ import annotations

import html
import ipaddress
import sys
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute form of a link on a page; what can't be resolved stays."""

    def one(b, r):
        try:
            return urljoin(b or "", r or "")
        except ValueError:
            return r

    return pd.Series([one(b, r) for b, r in zip(base, link)])


def is_private(url: str | None) -> bool:
    """Hosts that must not be exported: local names, and address literals outside of the public ranges."""
    if not url:
        return False
    try:
        name = (urlsplit(url).hostname or "").strip().lower().rstrip(".")
    except ValueError:
        return True
    if not name or name in ("localhost", "localhost.localdomain") or name.endswith((".localhost", ".local")):
        return True
    try:
        ip = ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return False
    return any((ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_multicast, ip.is_reserved, ip.is_unspecified))


@F.pandas_udf(T.BooleanType())
def private_host(url: pd.Series) -> pd.Series:
    """Each name of a batch is looked at once; null is no host."""
    known = {u: is_private(u) for u in url.dropna().unique()}
    return pd.Series([known.get(u, False) for u in url], dtype=bool)


def decoded_variants(text: str, floor: int = 2_000_000) -> list[tuple[str, str]]:
    """(name, text) of a text as it is, HTML-unescaped, with slashes unescaped, and percent-decoded once and twice; repeats left out."""
    slashes = text
    for escaped in ("\\/", "\\u002F", "\\u002f"):
        slashes = slashes.replace(escaped, "/")
    found = {text: "raw"}
    found.setdefault(html.unescape(text), "html_unescaped")
    found.setdefault(slashes, "json_slash_unescaped")
    now = text
    for name in ("url_decoded", "double_url_decoded"):
        after = unquote(now)
        if after == now or len(after) > max(floor, 20 * len(text)):
            break
        found.setdefault(after, name)
        now = after
    return [(n, t) for t, n in found.items() if t]
