"""Address functions as column expressions; what is no address gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of files that are no pages.
NOT_PAGES = "pdf|doc|docx|xls|xlsx|ppt|pptx|odt|ods|odp|zip|rar|7z|gz|tar|jpg|jpeg|png|gif|svg|webp|mp3|mp4|avi|csv|xml"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(u), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(u), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(F.trim(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_part(u: Column) -> Column:
    return F.regexp_extract(F.trim(u), r"^[^?#]*(\?[^#]*)", 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(F.trim(u), r"#(.*)$", 1)


def normalize_url(u: Column) -> Column:
    """Scheme and host in lower case, no slash at the end of the path (an empty path is /), the query kept, the fragment dropped."""
    p = F.regexp_replace(path(u), "/+$", "")
    out = F.concat(scheme(u), F.lit("://"), host(u), F.when(p == "", "/").otherwise(p), query_part(u))
    return F.when((scheme(u) != "") & (host(u) != ""), out)


def fragment_counts(frag: Column) -> Column:
    """Whether a fragment names a place of its own rather than a spot on the page."""
    return frag.rlike("^[!/]|:")


def resolve_link(base: Column, link: Column) -> Column:
    """A link against the page it stands on: http and https only, fragment dropped unless it counts."""
    link = F.trim(link)
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    full = (
        F.when(link.rlike("^[Hh][Tt][Tt][Pp][Ss]?://"), link)
        .when(link.rlike("^//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.rlike("^/"), F.concat(root, link))
        .when(link.rlike("^#"), F.concat(root, path(base), query_part(base), link))
        .when(link.rlike(r"^\?"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(link, r"^(\./)+", "")))
    )
    return F.when(fragment_counts(fragment(full)), full).otherwise(F.regexp_replace(full, "#.*$", ""))


def same_domain(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_file(u: Column) -> Column:
    return F.lower(path(u)).rlike(rf"\.(?:{NOT_PAGES})$")


def iso_name(u: Column) -> Column:
    return F.nullif(F.regexp_extract(fragment(u), r"(iso:std:[a-z0-9:-]+)", 1), F.lit(""))
