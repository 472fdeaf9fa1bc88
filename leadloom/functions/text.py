"""Text, e-mail, rating and social-profile functions: each takes and returns Columns."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They decide which addresses and handles are accepted.
BLOCKED_TLDS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "tiff", "tif", "avif", "heic", "heif", "raw",
    "2x", "3x", "4x", "5x", "0x", "1x",
    "pdf", "zip", "tar", "gz", "rar", "7z", "exe", "dll", "dmg", "pkg",
    "mp4", "mp3", "avi", "mov", "mkv", "wav", "flac",
    "css", "js", "ts", "py", "rb", "go", "rs", "java", "php", "sh", "bat",
    "json", "xml", "csv", "yml", "yaml", "toml",
]
JUNK_DOMAINS = [
    "example.com", "domain.com", "email.com", "yoursite.com", "website.com", "test.com",
    "sentry.io", "sentry.wixpress.com", "ingest.sentry.io", "amazonaws.com", "s3.amazonaws.com",
    "mailchimp.com", "mandrillapp.com", "sendgrid.net", "mailgun.org", "googlegroups.com", "googlemail.com",
    "wix.com", "wixpress.com", "squarespace.com", "webflow.io", "wordpress.com", "shopify.com",
    "sevenrooms.com", "opentable.com", "resy.com", "eatapp.co", "thefork.com", "bookatable.com",
]
#: Ends of an otherwise well-formed address that is none: a blocked last label, a junk domain or a subdomain of one.
NO_EMAIL = rf"(?:\.(?:{'|'.join(BLOCKED_TLDS)})|[@.](?:{'|'.join(map(re.escape, JUNK_DOMAINS))}))\z"
PHONE = r"(?iU)^\+?[\d\s\-\(\)\.ext]{7,25}$"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
EMAIL_SCAN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
CF_EMAIL = r"""data-cfemail=["']([0-9a-fA-F]+)["']"""
MAILTO = r"(?i)mailto:([^\"'?\s>]+)"
OBFUSCATED_AT = r"(?U)\s*(?:\[|\()?(?:at|AT)(?:\]|\))?\s*"
OBFUSCATED_DOT = r"(?U)\s*(?:\[|\()?(?:dot|DOT)(?:\]|\))?\s*"
SOCIAL_PATTERNS = {
    "facebook": r"(?iU)facebook\.com/(?!sharer|share|login|dialog|photo|video|events|permalink|groups/(?![\w.]+/))([\w.%-]{3,})",
    "instagram": r"""(?iU)instagram\.com/([\w.]{1,30})/?(?:["'\s>]|$)""",
    "twitter": r"""(?iU)(?:twitter|x)\.com/([\w]{1,15})(?:["'\s/>]|$)""",
    "linkedin": r"(?iU)linkedin\.com/(?:company|in|school)/([\w%-]{2,100})",
    "youtube": r"(?iU)youtube\.com/(?:(?:channel|user|c)/|@)([\w%-]{2,100})",
    "tiktok": r"""(?iU)tiktok\.com/@?([\w.]{2,30})(?:["'\s/>]|$)""",
}
SOCIAL_DOMAINS = {"facebook": "facebook.com", "instagram": "instagram.com", "twitter": "x.com", "linkedin": "linkedin.com", "youtube": "youtube.com", "tiktok": "tiktok.com"}
SKIP_HANDLES = [
    "home", "login", "logout", "signup", "register", "help", "support", "about", "privacy", "terms", "legal", "press",
    "business", "ads", "sharer", "share", "dialog", "intent", "hashtag", "people", "profile", "profile.php", "groups",
    "pages", "watch", "marketplace", "gaming", "messages", "notifications", "search", "settings", "friends", "events",
    "stories", "saved", "find-friends", "policies", "pg", "note", "biz", "explore", "accounts", "reels", "feed",
    "results", "playlist",
]
BOT_TERMS = ["just a moment...", "enable javascript", "cloudflare", "attention required!", "ddos-guard", "verify you are human"]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it: nested functions would repeat what is inside c many times over."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Neither null nor empty; white space counts as present."""
    return F.coalesce(c, F.lit("")) != ""


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    return nullif_empty(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def validate_phone(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(PHONE), s)


def validate_email(c: Column) -> Column:
    return let(F.lower(strip(c)), lambda e: F.when(e.rlike(EMAIL) & (F.length(e) <= 254) & ~e.rlike(NO_EMAIL), e))


def validate_rating(c: Column) -> Column:
    """0 to 5, rounded half-even to one decimal (of the decimal value; binary ties may differ from other engines)."""
    return F.when(c.between(0.0, 5.0), F.bround(c, 1))


def parse_rating_text(c: Column) -> Column:
    found = F.regexp_extract(F.translate(c, ",", "."), r"(\d+(?:\.\d+)?)", 1)
    return validate_rating(nullif_empty(found).try_cast("double"))


def parse_review_count(c: Column) -> Column:
    named = nullif_empty(F.translate(F.regexp_extract(c, r"(?i)([\d,]+)\s+reviews?", 1), ",", ""))
    plain = F.when((F.length(c) <= 20) & ~c.contains(".") & ~c.rlike("[a-zA-Z]"), nullif_empty(F.regexp_replace(c, r"[^\d]", "")))
    return F.coalesce(named.try_cast("long"), plain.try_cast("long"))


def decode_cf_email(c: Column) -> Column:
    """XOR of hex pairs with the first pair; null where the text is no even run of hex digits or no valid address."""
    byte = lambda h, i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).try_cast("int")

    def decoded(h: Column) -> Column:
        starts = F.sequence(F.lit(3), F.length(h) - 1, F.lit(2))
        chars = let(byte(h, F.lit(1)), lambda first: F.transform(starts, lambda i: F.char(byte(h, i).bitwiseXOR(first))))
        return F.array_join(chars, "")

    return let(c, lambda h: F.when(h.rlike("^([0-9a-fA-F]{2}){2,}$"), validate_email(decoded(h))))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: An address needs an at sign, or a character reference or word that may stand for one.
MAY_HOLD_EMAIL = r"@|&#|&commat|&l(?:s|br|p)|&nbsp|&[A-Z]| \[at\] | \(at\) | AT "


def unescape_html(c: Column) -> Column:
    """Character references decoded in texts that may hold an address; others are not passed to a Python worker."""
    return F.coalesce(_unescape(F.when(c.contains("&") & c.rlike(MAY_HOLD_EMAIL), c)), c)


def _valid(candidates: Column) -> Column:
    return F.filter(F.transform(candidates, validate_email), lambda e: e.isNotNull())


def find_emails(c: Column) -> Column:
    """All valid addresses in order: protected ones, plain ones, and only if there are none de-obfuscated ones."""
    return find_emails_unescaped(c, unescape_html(c))


def find_emails_unescaped(raw: Column, text: Column) -> Column:
    return let(F.struct(raw.alias("raw"), text.alias("text")), lambda v: _emails(v["raw"], v["text"]))


def _emails(raw: Column, text: Column) -> Column:
    none = F.array().cast("array<string>")
    protected = F.when(raw.contains("data-cfemail"), F.filter(F.transform(F.regexp_extract_all(raw, F.lit(CF_EMAIL), F.lit(1)), decode_cf_email), lambda e: e.isNotNull())).otherwise(none)
    plain = F.when(text.contains("@"), _valid(F.regexp_extract_all(text, F.lit(EMAIL_SCAN), F.lit(0)))).otherwise(none)
    hidden = F.regexp_replace(F.regexp_replace(text, OBFUSCATED_AT, "@"), OBFUSCATED_DOT, ".")
    marked = text.contains(" [at] ") | text.contains(" (at) ") | text.contains(" AT ")
    found = F.array_distinct(_valid(F.regexp_extract_all(hidden, F.lit(EMAIL_SCAN), F.lit(0))))
    return let(F.array_distinct(F.concat(protected, plain)), lambda both: F.when(raw.isNull(), none).when(F.size(both) > 0, both).when(marked, found).otherwise(none))


def find_email_in_html(c: Column) -> Column:
    """The first valid mailto address, else the first address in the text."""
    mailto = F.when(c.contains("mailto:") | c.rlike("(?i)mailto:"), F.get(_valid(F.regexp_extract_all(c, F.lit(MAILTO), F.lit(1))), F.lit(0)))
    return F.coalesce(mailto, F.get(find_emails(c), F.lit(0)))


def social_handle(platform: str, page: Column) -> Column:
    """The match and handle of the first link to a profile (struct), null if there is none."""
    found = F.regexp_extract_all(page, F.lit(SOCIAL_PATTERNS[platform]), F.lit(0))
    # a match by itself matches again, with the same handle
    pairs = F.transform(found, lambda m: F.struct(m.alias("raw"), F.regexp_extract(m, SOCIAL_PATTERNS[platform], 1).alias("handle")))
    return F.get(F.filter(pairs, lambda p: ~F.lower(F.trim(p["handle"], F.lit("/"))).isin(SKIP_HANDLES)), F.lit(0))


def social_url(platform: str, raw: Column, handle: Column) -> Column:
    """A canonical profile URL from a match and its handle."""
    root = F.lit(f"https://www.{SOCIAL_DOMAINS[platform]}/" + ("@" if platform == "tiktok" else ""))

    def url(cut: Column) -> Column:
        whole = F.concat(F.lit("https://www."), F.regexp_replace(cut, r"(?i)^(?:https?://)?(?:www\.)?", ""))
        return F.when(F.contains(F.lower(cut), F.lit(SOCIAL_DOMAINS[platform])), whole).otherwise(F.concat(root, F.lower(F.trim(handle, F.lit("/")))))

    found = let(F.rtrim(F.regexp_extract(raw, r"""^([^"'> \n\r\t]*)""", 1), F.lit("/")), url)
    if platform == "tiktok":
        found = let(found, lambda u: F.when(u.contains("/@"), u).otherwise(F.regexp_replace(u, r"(?i)(tiktok\.com/)(?!@)([\w.%-]+)", "$1@$2")))
    return found


def social_links(page: Column) -> Column:
    """A struct with one URL per platform."""

    def link(platform: str, p: Column) -> Column:
        return let(social_handle(platform, p), lambda m: F.when(m.isNotNull(), social_url(platform, m["raw"], m["handle"])))

    return let(page, lambda p: F.struct(*[link(platform, p).alias(platform) for platform in SOCIAL_PATTERNS]))


def is_bot_challenge(page: Column) -> Column:
    text = F.lower(page)
    stub = F.exists(F.array(*map(F.lit, BOT_TERMS)), lambda t: F.contains(text, t))
    return page.isNull() | (F.length(page) < 200) | ((F.length(page) < 20000) & stub)


def format_duration(seconds: Column) -> Column:
    total = seconds.cast("long")
    part = lambda d, m=None: ((total / d).cast("long") if m is None else (F.floor(total / d) % m)).cast("string")
    minutes, hours, days = F.floor(total % 3600 / 60), F.floor(total / 3600) % 24, F.floor(total / 86400)
    months, day, year = F.floor(days / 30) % 12, days % 30, F.floor(days / 360)
    week = F.floor(day / 7)
    s = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    hm = F.concat_ws(" ", s(hours, "h"), s(minutes, "m"))
    return (
        F.when(total < 60, s(total, "s"))
        .when(year > 0, F.concat_ws(" ", s(year, "yr"), s(months, "mo"), s(day, "d"), hm))
        .when(months > 0, F.concat_ws(" ", s(months, "mo"), s(day, "d"), hm))
        .when(week > 0, F.concat_ws(" ", s(week, "w"), s(day % 7, "d"), hm))
        .when(day > 0, F.concat_ws(" ", s(day, "d"), hm))
        .when(hours > 0, hm)
        .otherwise(s(minutes, "m"))
    )


def sanitize_filename(name: Column, most: int = 80) -> Column:
    safe = F.trim(F.regexp_replace(F.regexp_replace(name, r"""[<>:"/\\|?*\x00-\x1f]""", "_"), "_+", "_"), F.lit("_"))
    return F.when(safe != "", F.left(safe, F.lit(most))).otherwise("unnamed")


def location_of_query(query: Column) -> Column:
    return nullif_empty(strip(F.regexp_extract(strip(query), r"(?iU)\bin\s+(.+)$", 1)))


def resolve_query(query: Column, niche: Column, location: Column) -> Column:
    """query, else 'niche in location', else either; null if there is nothing."""
    q, n, p = nullif_empty(query), nullif_empty(niche), nullif_empty(location)
    return F.coalesce(strip(q), F.concat(strip(n), F.lit(" in "), strip(p)), strip(n), strip(p))
