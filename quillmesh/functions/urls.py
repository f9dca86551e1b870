"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, and public second-level suffixes.
TRACKING = r"^(utm_.*|oc|ocid|cmpid|smid|fbclid|gclid|ref)$"
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu", "or", "ne")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)


def base_domain(url: Column) -> Column:
    """the registrable domain: two labels, three under a second-level suffix."""
    parts = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    n = F.size(parts)
    keep = F.when((n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.when(n <= keep, F.array_join(parts, ".")).otherwise(F.array_join(F.slice(parts, n - keep + 1, keep), "."))


def canonical(url: Column) -> Column:
    """host and path, with the non-tracking parameters in order."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), path, query)


def article_id(url: Column) -> Column:
    """Sixteen hex digits of the address's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)
