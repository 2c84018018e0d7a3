"""Addresses and links as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Links that never lead to text, and addresses that are never fetched.
SKIP_SCHEMES = ("mailto:", "tel:", "javascript:", "data:", "sms:", "whatsapp:", "blob:")
SKIP_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif",
    ".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".zip", ".rar", ".7z", ".tar", ".gz", ".mp4", ".mp3", ".avi", ".mov", ".webm", ".wav",
)
SKIP_PATHS = r"(?i)/login|/logout|/signin|/signup|/register|/cart|/checkout|/wp-admin|/wp-login|/feed/?$|\?s=|/search|/tag/|/author/"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
CANONICAL = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical["']?[^>]*?\bhref\s*=\s*["']([^"']+)["']"""
SENSITIVE_PARAM = r"(?i)token|key|secret|pass|auth|code|sig|session|credential"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def absolute(link: Column, base: Column) -> Column:
    """``link`` as seen from the page ``base``; dots in paths stay as they are."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(root, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")))
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .otherwise(F.concat(folder, link))
    )


def without_fragment(url: Column) -> Column:
    bare = F.regexp_replace(url, "#.*$", "")
    return F.regexp_replace(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)(\?|$)", "$1/$2")


def for_visit(url: Column) -> Column:
    """The form by which visits are told apart: no fragment, no slash at the path's end."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"/+(\?|$)", "$1")


def links(html: Column, base: Column) -> Column:
    """Addresses that a page links to and that may hold text, absolute, each once, in order."""
    quoted = [F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3)]
    raw = F.transform(F.arrays_zip(*[q.alias(f"q{i}") for i, q in enumerate(quoted)]), lambda z: F.trim(F.concat(z["q0"], z["q1"], z["q2"])))
    skipped = lambda x: reduce(lambda a, b: a | b, [F.startswith(F.lower(x), F.lit(s)) for s in SKIP_SCHEMES])
    kept = F.filter(raw, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~skipped(x))
    found = F.transform(kept, lambda x: absolute(x, base))
    ends = "(?i)(" + "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS) + r")(\?.*)?(#.*)?$"
    good = F.filter(found, lambda u: u.rlike("^(?i)https?://") & ~u.rlike(ends) & ~u.rlike(SKIP_PATHS))
    return F.array_distinct(F.transform(good, without_fragment))


def canonical(html: Column, base: Column) -> Column:
    found = F.trim(F.regexp_extract(html, CANONICAL, 1))
    return F.when(found != "", absolute(found, base)).otherwise("")


def safe_query(query: Column) -> Column:
    """A query string with the values of sensitive parameters masked."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    masked = F.transform(pairs, lambda p: F.when(F.split(p, "=")[0].rlike(SENSITIVE_PARAM), F.concat(F.split(p, "=")[0], F.lit("=***"))).otherwise(p))
    return F.array_join(masked, "&")


def sniffed_type(head: Column, declared: Column) -> Column:
    """The type that content's first bytes show, else the declared one."""
    starts = lambda hex_: F.startswith(F.hex(head), F.lit(hex_))
    return (
        F.when(starts("25504446"), "application/pdf")
        .when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("504B") & ~F.contains(F.hex(F.substring(head, 1, 200)), F.lit("5B")), "application/zip")
        .when(starts("7B5C727466"), "application/rtf")
        .when(starts("D0CF11E0A1B11AE1"), "application/x-ole-storage")
        .otherwise(declared)
    )


#: Names and networks that are never fetched.
BLOCKED_HOSTS = {"localhost", "localhost.localdomain", "metadata", "metadata.google.internal", "instance-data", "169.254.169.254"}
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost", ".home.arpa")
BLOCKED_NETWORKS = ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4", "::/128", "64:ff9b::/96", "100::/64", "2001:db8::/32")


def refusal(url: str) -> str | None:
    """Why an address may not be fetched, or None. Names are not looked up."""
    try:
        parts = urlsplit(url or "")
        name = (parts.hostname or "").rstrip(".").lower()
        parts.port  # noqa: B018  raises on a bad port
    except ValueError:
        return "malformed"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if parts.username or parts.password:
        return "credentials"
    if not name or name in BLOCKED_HOSTS or name.endswith(BLOCKED_SUFFIXES):
        return "host"
    try:
        address = ipaddress.ip_address(name)
    except ValueError:
        return None
    blocked = any(address in ipaddress.ip_network(n) for n in BLOCKED_NETWORKS)
    return "address" if blocked or not address.is_global or address.is_multicast else None


@F.pandas_udf(StringType())
def refusal_of(url: pd.Series) -> pd.Series:
    """:func:`refusal` over a column; an empty or null address is refused by its scheme."""
    return url.map(lambda u: refusal(u or "")).astype(object)
