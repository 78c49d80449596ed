"""URLs, links and their kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlake.config import CODE_HINTS, DATA_HINTS, DEFAULTS, DROPPED_STARTS, GATEWAY, GATEWAY_END, INVISIBLE, URL_CHARS, URL_CLASS, URL_ENDS, Settings
from scholarlake.functions.doi import is_dataset
from scholarlake.functions.text import WORD, any_of, col, compact_letters, let, outside_urls, repair_scheme

_HOSTS = ("zenodo", "dryad", "github", "gitlab", "osf")
#: White space that a URL swallows: after a closing mark of its own, or where a URL mark is among the next 13 characters.
_GAP = r"http(s?://\S++)(?:(?<=[=\-_])\s++(?=\S)|\s++(?=[/?\-_=.]|\S[^/?\-_=.]{0,11}[/?\-_=.]))"


def is_url(x: Column | str) -> Column:
    """At least 10 characters, http(s), a host with a top-level domain, an optional path; no port."""
    x = col(x)
    return (F.length(x) >= 10) & x.rlike(r"^https?://[a-zA-Z0-9][\w\-.]*\.[a-zA-Z]{2,}(?:/\S*)?$")


def domain(x: Column | str) -> Column:
    """Lower-case host without a leading www.; null for other strings."""
    host = F.lower(F.regexp_extract(col(x), r"(?i)^https?://([^/]+)", 1))
    host = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)
    return F.nullif(host, F.lit(""))


def canonical(x: Column | str, passes: int = 10) -> Column:
    """Text as links are read from it: no invisible characters, no mail gateway around links, known hosts and broken URLs glued.

    Host names are glued inside URLs only."""
    x = let(col(x), lambda text: F.when(any_of(text, INVISIBLE.strip("[]")), F.regexp_replace(text, INVISIBLE, "")).otherwise(text))

    def glue(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, GATEWAY, ""), GATEWAY_END, "$2")
        for name in _HOSTS:
            x = F.regexp_replace(x, r"(?i)(https?://(?:www\.)?)" + r"\s*".join(name) + r"\s*\.\s*(?=org|com|io)", f"$1{name}.")
        for _ in range(passes):
            x = F.regexp_replace(x, _GAP, "http$1")
        return x

    def from_first(text: Column) -> Column:
        """All that is glued begins with a scheme or two underscores, so what is before the first of them stays as it is."""
        before = F.get(F.split(text, r"(?i)https?://|__", 2), F.lit(0))
        return let(before, lambda head: F.concat(head, let(F.substr(text, F.length(head) + 1), glue)))

    return let(x, lambda text: F.when(text.contains("__") | F.lower(text).contains("http"), from_first(text)).otherwise(text))  # most texts have no link


#: A URL of a page's layout: a scheme, then URL characters up to the most, white space between them swallowed unless an
#: end word follows. After the last character of the most no white space is swallowed. Possessive, so it never backtracks.
_SPACE = r"(?:[\t\n\r]|(?! (?:" + "|".join(URL_ENDS) + ") ) )"
_LAYOUT_URL = rf"(?i:https?://)(?:(?:{_SPACE}*+{URL_CLASS}){{{URL_CHARS}}}+|(?:{_SPACE}*+{URL_CLASS}){{0,{URL_CHARS - 1}}}+{_SPACE}*+)"


def layout_urls(x: Column | str) -> Column:
    """For text from page layout: no invisible characters, no mail gateway, schemes repaired, then in each URL all white space
    taken out up to an end word, another character or the most characters. One pass over the text: what matches is a URL,
    what is between matches stays."""
    x = repair_scheme(F.regexp_replace(F.regexp_replace(col(x), INVISIBLE, ""), GATEWAY, ""))

    def glue(text: Column) -> Column:
        glued = F.transform(F.regexp_extract_all(text, F.lit(_LAYOUT_URL), F.lit(0)), lambda u: F.translate(u, " \t\n\r", ""))
        parts = F.zip_with(F.split(text, _LAYOUT_URL, -1), glued, lambda between, url: F.concat(between, F.coalesce(url, F.lit(""))))
        return F.when(text.rlike("(?i)https?://"), F.array_join(parts, "")).otherwise(text)

    return let(x, glue)


def clean_paragraph(x: Column | str) -> Column:
    """Layout clean-up of a paragraph: dashes, broken words, spacing, URLs, spaced letters outside URLs, fused URLs cut; null if it is one of those that are dropped."""
    x = F.regexp_replace(col(x), "[\u2013\u2014]", "-")
    x = F.regexp_replace(x, rf"(?U)({WORD})-\s*\n\s*({WORD})", "$1$2")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, r" ([.,])", "$1")
    x = outside_urls(layout_urls(x), compact_letters)
    x = F.regexp_replace(x, r"(https?://\S{10,}?)(https?://)", "$1 $2")
    dropped = "(?i)^(?:" + "|".join(DROPPED_STARTS) + ")|\u00a9|copyright"
    return let(x, lambda text: F.when(~text.rlike(dropped), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))


def glue_host(x: Column | str) -> Column:
    """One pass over a spaced host name after a scheme, up to its top-level domain."""
    return F.regexp_replace(col(x), r"(https?://[a-z]+)\s+([a-z]+\.(?:org|com|io))", "$1$2")


def found_urls(x: Column | str) -> Column:
    """All http(s) strings of a text in order; fused ones are cut before each scheme."""
    found = F.regexp_extract_all(col(x), F.lit(r"(https?://[^\s)]+)"), F.lit(1))
    return F.filter(F.flatten(F.transform(found, lambda u: F.split(u, "(?=https?://)"))), lambda u: u != "")


def clean_link(x: Column | str) -> Column:
    """Trimmed, without closing punctuation, www. with a scheme; null for other schemes."""
    x = F.regexp_replace(F.trim(col(x)), r"[.,;)\]}]+$", "")
    return F.when(x.rlike("^https?://"), x).when(F.lower(x).startswith("www."), F.concat(F.lit("https://"), x))


def is_dataset_link(x: Column | str, settings: Settings = DEFAULTS) -> Column:
    x = F.lower(col(x))
    after = F.regexp_extract(x, r"(?s)^.*?doi\.org/(.*)$", 1)
    return x.contains("doi.org/") & is_dataset(after, settings.dataset_prefixes, slash=False)


def is_accepted(x: Column | str, kind: str, settings: Settings = DEFAULTS) -> Column:
    """Whether a clean link counts for `kind`."""
    x = col(x)
    host = domain(x)
    allowed = host.isin(*(settings.data_domains if kind == "data" else settings.code_domains))
    if kind == "data":
        allowed = allowed | (host.isin("doi.org", "dx.doi.org") & is_dataset_link(x, settings))
    return F.coalesce(~any_of(F.lower(x), settings.denied) & allowed & is_url(x), F.lit(False))


def accepted(urls: Column, kind: str, settings: Settings = DEFAULTS) -> Column:
    """Distinct accepted links of an array, cleaned, in order."""
    return F.array_distinct(F.filter(F.transform(urls, clean_link), lambda u: is_accepted(u, kind, settings)))


def links(x: Column | str, kind: str, settings: Settings = DEFAULTS) -> Column:
    """Distinct accepted links of a text in order."""
    return accepted(found_urls(x), kind, settings)


def inspected(x: Column | str) -> Column:
    """A link as an inspector would list it; null if it is none."""
    x = F.trim(col(x))
    x = F.when(x.startswith("www."), F.concat(F.lit("https://"), x)).otherwise(x)
    return F.when(x.rlike("(?i)^https?://"), F.regexp_replace(x, r"[),.;\]]+$", ""))


def link_kind(x: Column | str) -> Column:
    low = F.lower(col(x))
    return F.when(any_of(low, DATA_HINTS), "data").when(any_of(low, CODE_HINTS), "code").otherwise("other")
