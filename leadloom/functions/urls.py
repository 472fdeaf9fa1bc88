"""URL functions: normalisation, coordinates, place ids and contact links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nullif_empty, strip

# Domains that are no business web site, and path words of contact pages.
SOCIAL_SITES = ["facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "snapchat.com", "t.me", "telegram.me", "wa.me", "whatsapp.com", "threads.net"]
SOCIAL_HOST = rf"(?:^|\.)(?:{'|'.join(map(re.escape, SOCIAL_SITES))})\z"
CONTACT_WORDS = ["contact", "about", "team", "reach", "connect", "privacy", "impressum", "agent"]
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def host(url: Column) -> Column:
    """Lower-case host without any leading letters w and dots."""
    return F.ltrim(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)), F.lit("w."))


def validate_url(c: Column, reject_social: bool = False) -> Column:
    def checked(url: Column) -> Column:
        ok = F.regexp_extract(url, r"^https?://([^/?#]*)", 1) != ""
        return F.when(ok & ~host(url).rlike(SOCIAL_HOST) if reject_social else ok, url)

    whole = lambda s: F.when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), s))
    return let(let(strip(c), whole), checked)


def normalize_url(c: Column) -> Column:
    """Without query, fragment, parameters of the last segment and trailing slashes."""
    base = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r";[^/]*$", "")
    return F.regexp_replace(base, r"(?<=[^/:])/+$", "")


def coords_of_url(url: Column) -> Column:
    """struct(lat, lng) of '@lat,lng', else '!3dlat!4dlng'; an '@' pair out of range gives null without a second try."""
    at, data = r"@(-?\d+\.\d+),(-?\d+\.\d+)", r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"
    pick = lambda i: F.when(url.rlike(at), F.regexp_extract(url, at, i)).otherwise(nullif_empty(F.regexp_extract(url, data, i)))
    return validate_coordinates(pick(1).try_cast("double"), pick(2).try_cast("double"))


def validate_coordinates(lat: Column, lng: Column) -> Column:
    return F.when(lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0), F.struct(lat.alias("lat"), lng.alias("lng")))


def place_id_of_url(url: Column) -> Column:
    """The hexadecimal id, else the place_id=ChIJ... parameter."""
    return F.coalesce(nullif_empty(F.regexp_extract(url, r"(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", 1)), nullif_empty(F.regexp_extract(url, r"place_id=(ChIJ[A-Za-z0-9_-]+)", 1)))


def url_decode(c: Column) -> Column:
    """Percent decoding that keeps a plus sign."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def place_id_of_data(url: Column) -> Column:
    """'!1sChIJ...' of the data segment, else the place_id parameter of the query."""
    query = nullif_empty(F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"[?&]place_id=([^&]*)", 1))
    return F.coalesce(url_decode(nullif_empty(F.regexp_extract(url, r"!1s(ChIJ[^!&?]+)", 1))), F.try_url_decode(query))


def unwrap_website(href: Column) -> Column:
    """The target of a '/url?q=' redirect or the link itself, if it is no social site."""
    target = lambda h: F.try_url_decode(nullif_empty(F.regexp_extract(h, r"[?&]q=([^&#]*)", 1)))
    return let(href, lambda h: validate_url(F.when(h.contains("/url?q="), target(h)).otherwise(h), True))


def query_plus(c: Column) -> Column:
    """Query quoting: space to plus, tilde kept, asterisk encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def is_tiny_image(url: Column) -> Column:
    w, h = (F.regexp_extract(url, r"=w(\d+)-h(\d+)", i).try_cast("int") for i in (1, 2))
    return F.coalesce((w <= 100) | (h <= 100), F.lit(False))


def upsize_image(url: Column) -> Column:
    return F.regexp_replace(url, r"=w\d+-h\d+[-\w]*$", "=w1200-h900-p-k-no")


def contact_paths(page: Column, base: Column) -> Column:
    """Paths of links to contact pages of the same site, in order and once each.

    Absolute, protocol-relative, root-relative and simple relative links are resolved; a relative link with dot segments is
    resolved by dropping './' in front only.
    """
    scheme_host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    own = host(base)

    def full(h: Column) -> Column:
        return (
            F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(F.lit("https:"), h))
            .when(h.startswith("/"), F.concat(scheme_host, h))
            .when(h.startswith("?"), base)
            .otherwise(F.concat(scheme_host, folder, F.regexp_replace(h, r"^(\./)+", "")))
        )

    links = F.transform(F.regexp_extract_all(page, F.lit(HREF), F.lit(1)), strip)
    links = F.filter(links, lambda h: (h != "") & ~h.rlike(r"^(#|javascript:|mailto:|tel:)"))
    same = F.filter(F.transform(links, full), lambda u: (host(u) == "") | (host(u) == own))
    paths = F.transform(same, lambda u: F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", ""))
    wanted = lambda p: (p != "") & (p != "/") & F.exists(F.array(*map(F.lit, CONTACT_WORDS)), lambda k: F.contains(F.lower(p), k))
    return F.coalesce(F.array_distinct(F.filter(paths, wanted)), F.array().cast("array<string>"))
