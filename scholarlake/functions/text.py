"""Text normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlake.config import SPLIT_AT

_MARK = "\u0001"
#: What belongs to a word.
WORD = r"[\p{L}\p{N}_]"
#: White space of any kind, and that within a line.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INLINE = SPACE.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Before a pattern that starts with white space: passes over other characters by one test of their range, and is none itself.
_AT_SPACE = r"(?![!-~\x{a1}-\x{167f}])"
#: Marks that end a sentence, also several in this order.
_MARKS = (".", "!", "?", ";", ".!", "!?", "?;", ".!?", "!?;", ".!?;")
#: What starts a sentence: upper case, digits also where they are raised, lowered or circled.
_UPPER = r"\p{IsUppercase}\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
#: Characters of which texts hardly have one, and never all.
_CUTS = ("\u0001", "\u0002", "\u0003", "\u0004")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def any_of(x: Column, words) -> Column:
    """Whether x contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def collapse(x: Column | str) -> Column:
    """Trimmed, white space runs as one space. What is one space already is not matched."""
    return F.trim(F.regexp_replace(col(x), r"[\t\n\x0b\f\r]\s*+| \s++", " "))


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.trim(x, F.lit(_SPACES))


def dehyphenate(x: Column | str) -> Column:
    """Words broken by a hyphen at a line end are joined."""
    return F.regexp_replace(col(x), r"(\w)-\n(\w)", "$1$2")


def repair_scheme(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?i)(https?)\s*:\s*/\s*/\s*", "$1://")


def join_lines(x: Column | str) -> Column:
    """Lines are trimmed and joined by a space unless the one before ends a sentence; blank lines keep one paragraph break."""
    x = F.regexp_replace(col(x), rf"{_AT_SPACE}(?<!{SPACE}){_INLINE}++\z", "")
    x = F.regexp_replace(x, rf"{_AT_SPACE}(?<!{_INLINE}){_INLINE}*+\n(?:{_INLINE}*+\n)++{_INLINE}*+", _MARK)
    x = F.regexp_replace(x, rf"{_AT_SPACE}(?<!{_INLINE}){_INLINE}*+\n{_INLINE}*+", "\n")
    x = F.regexp_replace(x, r"\n(?<![.!?;\x01]\n)", " ")
    return F.replace(x, F.lit(_MARK), F.lit("\n\n"))


def compact_letters(x: Column | str) -> Column:
    """Five or more single letters set apart by spaces become one word; URLs have no such runs.

    A character beyond 16 bits before a run does not count as a part of its first letter's word."""
    letter = rf"[a-zA-Z](?!{WORD})"
    # \G first: within a run, what follows a letter is not looked at again for each of its letters
    return F.regexp_replace(col(x), rf"(?:(?!^)\G|(?<!{WORD})(?=(?:{letter}{SPACE}+){{4}}{letter}))([a-zA-Z]){SPACE}+(?={letter})", "$1")


def outside_urls(x: Column | str, change) -> Column:
    """x with `change` made to what is between URLs; neighbours of a URL count as within a word."""
    url = r"(?i:https?://)\S+"

    def one(part: Column, i: Column) -> Column:
        after, before = (i > 0).cast("int"), part["url"].isNotNull().cast("int")
        edge = lambda n: F.repeat(F.lit("_"), n)
        changed = let(change(F.concat(edge(after), part["text"], edge(before))), lambda t: F.substr(t, after + 1, F.length(t) - after - before))
        return F.concat(changed, F.coalesce(part["url"], F.lit("")))

    def every(text: Column) -> Column:
        parts = F.zip_with(F.split(text, url, -1), F.regexp_extract_all(text, F.lit(url), F.lit(0)), lambda t, u: F.struct(t.alias("text"), u.alias("url")))
        return F.when(text.rlike(url), F.array_join(F.transform(parts, one), "")).otherwise(change(text))

    return let(col(x), every)


def sentences(x: Column | str) -> Column:
    """Array of sentences. Cuts are possible after . ! ? ; and white space; a cut is made where nothing, an upper-case letter or a digit
    follows, else the parts are joined again by one space, a mark without space before it. What consists of such marks alone,
    in this order, counts as one.

    Whether a cut is made depends on the part before and after it alone, so the parts are joined with a character that the text
    does not have at each cut, and taken apart there. Where no part begins with a mark, none consists of marks, and replacements
    in the text do the same without an array of its parts."""
    mark, space = "[.!?;]", rf"{SPACE}++"

    def unused_in(text: Column) -> Column:
        unused = F.lit(_CUTS[-1])
        for c in reversed(_CUTS[:-1]):
            unused = F.when(~text.contains(c), c).otherwise(unused)
        return unused

    def plain(text: Column) -> Column:
        unused = unused_in(text)
        out = F.regexp_replace(text, rf"{_AT_SPACE}(?<!{SPACE}){space}(?={mark}{SPACE})", "")
        out = F.regexp_replace(out, F.lit(rf"({mark}){space}(?=[{_UPPER}]|\z)"), F.concat(F.lit("$1"), unused))
        out = F.regexp_replace(out, rf"({mark}){space}", "$1 ")
        return F.filter(F.split(strip(out), unused), lambda s: s != "")

    def by_parts(text: Column) -> Column:
        unused = unused_in(text)
        marks = F.regexp_extract_all(text, F.lit(rf"([.!?;]){SPACE}+"), F.lit(1))
        parts = F.filter(F.flatten(F.zip_with(F.split(text, rf"[.!?;]{SPACE}+", -1), marks, lambda t, m: F.array(t, m))), lambda p: p.isNotNull())

        def piece(part: Column, following: Column) -> Column:
            next_mark = F.coalesce(following.isin(*_MARKS), F.lit(False))
            ends = F.coalesce(~strip(following).rlike(rf"^[^{_UPPER}]"), F.lit(True))
            of_mark = F.concat(part, F.when(ends, unused).when(next_mark, "").otherwise(" "))
            return F.when(part.isin(*_MARKS), of_mark).otherwise(F.concat(strip(part), F.when(next_mark, "").otherwise(" ")))

        joined = let(parts, lambda all_: F.array_join(F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), lambda p, f: F.when(p.isNotNull(), piece(p, f))), ""))
        return F.filter(F.transform(F.split(joined, unused), strip), lambda s: s != "")

    return let(col(x), lambda text: F.when(text.rlike(rf"(?:\A|{mark}{SPACE}){SPACE}*+{mark}"), by_parts(text)).otherwise(plain(text)))


def statement_sentences(x: Column | str) -> Column:
    """As sentences(), with ASCII classes and without the semicolon."""
    marked = F.regexp_replace(F.trim(col(x)), r"([.!?])\s+(?=[A-Z0-9])", "$1" + _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), lambda s: F.trim(s)), lambda s: s != "")


def normalize(x: Column | str) -> Column:
    """The whole chain over raw text; one sentence a line, three or more line feeds as two."""
    x = F.regexp_replace(col(x), rf"({WORD})-\n({WORD})", "$1$2")
    x = F.regexp_replace(x, rf"(?i)(https?){SPACE}*:{SPACE}*//{SPACE}*", "$1://")
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[ \\t]{2,}", " ")
    lines = F.array_join(sentences(outside_urls(join_lines(x), compact_letters)), "\n")
    return F.regexp_replace(lines, r"\n{3,}", "\n\n")


def paragraphs(x: Column | str) -> Column:
    """Array of paragraphs between blank lines, each on one line."""
    parts = F.split(F.regexp_replace(col(x), "\r\n?", "\n"), r"\n\s*\n")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")


def repair_spacing(x: Column | str) -> Column:
    x = F.regexp_replace(col(x), r"(\w)-\s+(\w)", "$1$2")
    x = F.regexp_replace(F.replace(x, F.lit(" - "), F.lit("-")), r"\s+", " ")
    return F.regexp_replace(x, r"\s+([,.:])", "$1")


def alpha_ratio(x: Column | str) -> Column:
    x = col(x)
    return F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.length(x)


def singleton_ratio(x: Column | str) -> Column:
    """Share of one-letter tokens."""
    tokens = F.filter(F.split(col(x), r"\s+"), lambda t: t != "")
    return F.coalesce(F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$"))) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))


def word_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(col(x), r"\s+"), lambda t: t != ""))


def tokens(x: Column | str) -> Column:
    """Distinct lower-case alphanumeric tokens of at least three characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if a side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def chunks(x: Column | str, size: int, overlap: int) -> Column:
    """Array of windows of `size` characters, each starting size - overlap after the one before."""
    x = col(x)
    last = F.greatest(F.lit(0), F.ceil((F.length(x) - overlap) / F.lit(size - overlap)) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(x, i * (size - overlap) + 1, F.lit(size)))


def _pieces(x: Column, at: str) -> Column:
    """x cut before each `at`, which stays with what follows; no empty pieces."""
    parts = F.transform(F.split(x, at, -1), lambda p, i: F.when(i > 0, F.concat(F.lit(at), p)).otherwise(p))
    return F.filter(parts, lambda p: p != "")


def _leaves(x: Column, size: int, overlap: int, at: tuple[str, ...]) -> Column:
    """Array of (text, opens): pieces shorter than size, each from the coarsest cut that makes it so; opens: no merge with the one before.

    What has no cut left is given as windows, which nothing is merged with."""
    leaf = lambda text, opens: F.struct(text.alias("text"), opens.alias("opens"))
    if not at:
        return F.transform(chunks(x, size, overlap), lambda w: leaf(w, F.lit(True)))
    pieces = F.transform(_pieces(x, at[0]), lambda p: F.struct(p.alias("p"), (F.length(p) >= size).alias("long")))

    def expand(all_: Column, piece: Column, i: Column) -> Column:
        opens = (i == 0) | F.coalesce(F.get(all_, i - 1)["long"], F.lit(False))
        return F.when(piece["long"], _leaves(piece["p"], size, overlap, at[1:])).otherwise(F.array(leaf(piece["p"], opens)))

    # the pieces as one element of an array: made once, and each can look at its neighbour
    return F.flatten(F.transform(F.array(pieces), lambda all_: F.flatten(F.transform(all_, lambda p, i: expand(all_, p, i)))))


def recursive_chunks(x: Column | str, size: int, overlap: int, at: tuple[str, ...] = SPLIT_AT) -> Column:
    """Array of chunks of at most `size` characters: x is cut at the coarsest marks, pieces that stay too long at the next
    finer ones, at last between characters; then pieces are merged greedily, each chunk beginning with pieces of the one
    before it of at most `overlap` characters. White space around a chunk is left out, and so are blank ones.

    A fold over the pieces holds those of the open chunk and the chunks so far."""

    def closed(held: Column) -> Column:
        return F.when(F.size(held["open"]) > 0, F.concat(held["out"], F.array(strip(F.array_join(held["open"], ""))))).otherwise(held["out"])

    def fold(held: Column, leaf: Column) -> Column:
        more = F.length(leaf["text"])
        full = held["total"] + more > size
        first = F.struct(F.lit(0).alias("gone"), held["total"].alias("left"))

        def drop(state: Column, piece: Column) -> Column:
            over = (state["left"] > overlap) | ((state["left"] + more > size) & (state["left"] > 0))
            return F.when(over, F.struct((state["gone"] + 1).alias("gone"), (state["left"] - F.length(piece)).alias("left"))).otherwise(state)

        kept = F.aggregate(held["open"], first, drop)
        rest = F.slice(held["open"], kept["gone"] + 1, F.size(held["open"]))
        none = F.array().cast("array<string>")
        make = lambda open_, total, out: F.struct(F.concat(open_, F.array(leaf["text"])).alias("open"), (total + more).alias("total"), out.alias("out"))
        return F.when(leaf["opens"], make(none, F.lit(0), closed(held))).when(full, make(rest, kept["left"], closed(held))).otherwise(make(held["open"], held["total"], held["out"]))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))
    return F.filter(F.aggregate(_leaves(col(x), size, overlap, at), start, fold, closed), lambda c: c != "")


def parse_list(x: Column | str) -> Column:
    """A JSON array or comma list as trimmed lower-case entries."""
    x = col(x)
    items = F.coalesce(F.from_json(x, "array<string>"), F.split(x, ","))
    return F.filter(F.transform(items, lambda s: F.lower(F.trim(s))), lambda s: s != "")


def none_to_null(x: Column | str) -> Column:
    """Answers that mean nothing was found."""
    x = col(x)
    return F.when(~F.lower(F.trim(x)).isin("none", "not found", "n/a", "na", ""), x)


def split_simple(x: Column | str) -> Column:
    """Parts between blank lines, trimmed; any kind of line end."""
    x = F.regexp_replace(F.regexp_replace(col(x), "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.filter(F.transform(F.split(x, "\n\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def merge_headings(paragraphs: Column | str) -> Column:
    """A paragraph under 80 characters that ends with a colon takes the next one; one that was taken takes none."""

    def fold(held: Column, p: Column) -> Column:
        out, last = held["out"], F.element_at(held["out"], -1)
        merged = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), p)))
        opens = p.endswith(":") & (F.length(p) < 80)
        return F.when(held["open"], F.struct(merged.alias("out"), F.lit(False).alias("open"))).otherwise(F.struct(F.concat(out, F.array(p)).alias("out"), opens.alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(col(paragraphs), start, fold)["out"]


def merge_broken_urls(paragraphs: Column | str, most: int = 2) -> Column:
    """A paragraph that ends with a bare scheme takes up to `most` followers until the URL has a host."""

    def fold(held: Column, p: Column) -> Column:
        out, last = held["out"], F.element_at(held["out"], -1)
        broken = (F.size(out) > 0) & last.rlike(r"(?i)https?:(?:\s*/\s*/)?\s*$") & (held["taken"] < most)
        joined = repair_scheme(F.concat(F.regexp_replace(last, r"\s+$", ""), p))
        merged = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))
        grown = F.struct(F.concat(out, F.array(p)).alias("out"), F.lit(0).alias("taken"))
        return F.when(broken, F.struct(merged.alias("out"), (held["taken"] + 1).alias("taken"))).otherwise(grown)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("taken"))
    return F.aggregate(col(paragraphs), start, fold)["out"]
