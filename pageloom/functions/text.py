"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pictographs, regional indicators, joiners; the namespace of package ids.
EMOJI = "[\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\u2300-\\u23FF\\u2600-\\u27BF\\u2B00-\\u2BFF\\uFE0F\\u200D]"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """White space (Unicode's and the file, group, record and unit separators) collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def slug(c) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, trimmed, then cut at 80; ``article`` if empty."""
    dashed = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(80))
    return F.when(F.length(cut) > 0, cut).otherwise("article")


def download_name(c) -> Column:
    """Like :func:`slug` without the cut, one dash trimmed at each end."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.when(F.length(dashed) > 0, dashed).otherwise("article"), F.lit(".epub"))


def file_stem(title, url) -> Column:
    """Slug of the title and eight digits of the address's hash."""
    return F.concat(slug(title), F.lit("-"), F.left(F.sha2(F.encode(_col(url), "UTF-8"), 256), F.lit(8)))


def package_id(url) -> Column:
    """The version 5 UUID of an address."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(_col(url), "UTF-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def without_emojis(c) -> Column:
    return F.regexp_replace(_col(c), EMOJI, "")


def escape_html(c) -> Column:
    out = _col(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def excerpt(c, n: int = 180) -> Column:
    """Texts of more than ``n`` characters are cut three earlier and end in an ellipsis."""
    c = clean_text(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("…"))).otherwise(c)


# What is cut from a byline, month names among it.
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


BYLINE_CUTS = [
    (r"\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b", " "),
    (r"(?<!\w)@[\w.-]+", " "),
    (r"https?://\S+", " "),
    (r"^(?:written\s+by|authored\s+by|author\s*:|by\s*:?)\s*", ""),
    (rf"\b{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?[,]?\s+\d{{4}}\b.*$", ""),
    (r"\b\d+\s*(?:mins?|minutes?)\s+read\b.*$", ""),
    (r"\s+[|•·]\s+.*$", ""),
    (r"\s+(?:follow|connect|contact|email|subscribe)\b.*$", ""),
    ("[<>]", ""),
    (r"^[ ,;|·•()]+|[ ,;|·•()]+$", ""),
    (r"\(\s*\)", ""),
]


def author_name(c) -> Column:
    """A byline without addresses, handles, lead-in, date, reading time and calls to follow."""
    out = clean_text(c)
    for pattern, new in BYLINE_CUTS:
        out = F.regexp_replace(out, f"(?iU){pattern}", new)
    return clean_text(out)


def iso_date(c) -> Column:
    """The local date of an ISO date (extended, basic or by week) or timestamp; null if there is none."""
    text = clean_text(c)
    extended = F.try_to_date(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    basic = F.try_to_date(F.regexp_extract(text, r"^(\d{8})(?:$|[T ]\d)", 1), "yyyyMMdd")
    part = lambda n: F.coalesce(*(F.nullif(F.regexp_extract(text, p, n), F.lit("")) for p in (r"^(\d{4})-W(\d{2})-([1-7])(?:$|[T ]\d)", r"^(\d{4})W(\d{2})([1-7])(?:$|[T ]\d)"))).cast("int")
    # The week that holds January 4 is the first; the last one holds December 28.
    monday = lambda d: F.date_sub(d, F.weekday(d))
    first, last = (monday(F.make_date(part(1), F.lit(m), F.lit(d))) for m, d in ((1, 4), (12, 28)))
    start = F.date_add(first, 7 * (part(2) - 1))
    by_week = F.when((part(2) >= 1) & (start <= last), F.date_add(start, part(3) - 1))
    return F.coalesce(extended, basic, by_week)


def distinct_in_order(values, order) -> Column:
    """An aggregate: different values in the order of their first occurrence."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(_col(order).alias("o"), _col(values).alias("v")))), lambda s: s["v"])
    return F.array_distinct(listed)
