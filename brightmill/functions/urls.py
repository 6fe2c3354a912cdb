"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightmill.sources.views import TRACKING

_NAMES = "|".join(TRACKING)
# Hosts inside a service's own network.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.google", "instance-data", "169.254.169.254", "0.0.0.0", "[::1]")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, fragment or trailing slashes."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    origin = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    clean = F.concat(F.lower(origin), F.substring(bare, F.length(origin) + 1, F.lit(1 << 30)))
    query = F.regexp_replace(F.regexp_replace(clean, rf"(?<=[?&])(?:{_NAMES})(?:=[^&]*)?(?:&|$)", ""), r"[?&]$", "")
    return F.regexp_replace(query, r"/+$", "")


def domain(url: Column) -> Column:
    """Host without a leading `www.`; the text itself if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", url).otherwise(F.regexp_replace(host, r"^www\.", ""))


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, by the first rule that fails; null if it may."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    a, b = (F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", g) for g in (1, 2))
    x, y = (F.coalesce(c.try_cast("int"), F.lit(-1)) for c in (a, b))
    private = (x == 127) | (x == 10) | ((x == 172) & y.between(16, 31)) | ((x == 192) & (y == 168)) | ((x == 169) & (y == 254)) | (x == 0)
    return (
        F.when(F.contains(url, F.lit("\0")), "null byte").when((scheme == "") | ((host == "") & scheme.isin("http", "https")), "invalid").when(~scheme.isin("http", "https"), "protocol")
        .when(host.isin(*BLOCKED_HOSTS), "internal host").when(private, "private address").when(F.startswith(host, F.lit("[")), "ipv6")
    )
