"""Of addresses: hosts, routes to site handlers, and which may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.extract.sites import ROUTES


def host_of(url: Column) -> Column:
    """The host in lower case without port and user."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), r"^\[|\]$", ""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^(www\.)+", "")


def host_is(url: Column, *hosts: str) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "").isin(*hosts)


def host_below(url: Column, suffix: str) -> Column:
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return (host == suffix) | host.endswith("." + suffix)


def route(url: Column) -> Column:
    """The name of the site handler that a page goes to: one CASE, so that filters on it reach the scan's rows before any Python."""
    out = None
    for name, pattern, handler in ROUTES:
        if handler is not None and pattern:
            test = F.coalesce(url, F.lit("")).rlike(pattern)
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(ROUTES[-1][0])


def may_be_fetched(url: Column) -> Column:
    """Whether an address is http or https and its host neither local nor a private address."""
    host = host_of(url)
    n = F.split(host, r"\.")
    part = lambda i: F.get(n, F.lit(i)).try_cast("int")
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private4 = (
        part(0).isin(0, 10, 127) | (part(0) >= 224) | ((part(0) == 169) & (part(1) == 254)) | ((part(0) == 172) & part(1).between(16, 31))
        | ((part(0) == 192) & (part(1) == 168)) | ((part(0) == 100) & part(1).between(64, 127))
    )
    mapped = F.regexp_extract(host, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    private6 = host.contains(":") & (host.isin("::", "::1") | host.rlike("^f[cd]") | host.rlike("^fe[89ab]") | host.rlike("^ff") | (mapped != ""))
    local = (host == "localhost") | host.rlike(r"\.(local|internal|lan|localhost)$")
    return F.coalesce(url.rlike("(?i)^https?://") & (host != "") & ~local & ~(v4 & private4) & ~private6, F.lit(False))
