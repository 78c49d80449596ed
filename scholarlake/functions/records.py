"""Statements, licenses, status, files and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlake.config import EMBEDDED, FUTURE, JOURNAL_HEADER, LICENSES, RESTRICTED, STATEMENT_GAP, STATEMENT_NEEDS, STATEMENT_WORDS, TITLE_STOPWORDS
from scholarlake.functions.text import alpha_ratio, any_of, col, collapse, word_count


def states_availability(x: Column | str, kind: str) -> Column:
    """A subject, then within 80 characters without a full stop a verb of availability."""
    subject, verb = STATEMENT_WORDS[kind]
    return col(x).rlike(f"(?i){subject}{STATEMENT_GAP}{verb}")


def may_state(low: Column, kind: str) -> Column:
    """Whether a text, given in lower case, has words without which neither it nor a part of it states availability."""
    subjects, verbs = STATEMENT_NEEDS[kind]
    return any_of(low, verbs) & any_of(low, subjects)


def availability_status(statement: Column | str, n_links: Column | str, kind: str) -> Column:
    statement, n_links = col(statement), col(n_links)
    s = F.lower(statement)
    embedded = any_of(s, EMBEDDED) & (n_links == 0) if kind == "data" else F.lit(False)
    return (
        F.when(F.coalesce(statement, F.lit("")) == "", "none")
        .when(any_of(s, FUTURE), "future")
        .when(any_of(s, RESTRICTED), "restricted")
        .when(embedded, "embedded")
        .when(n_links > 0, "open")
        .otherwise("none")
    )


def normalize_license(x: Column | str) -> Column:
    """A short name by the first pattern that matches; else the text with single spaces."""
    x = col(x)
    low, out = F.lower(F.trim(x)), collapse(x)
    for pattern, name in reversed(LICENSES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(x != "", out)


def license_answer(x: Column | str) -> Column:
    """Answers under five characters are none."""
    return F.when(F.length(F.trim(col(x))) >= 5, col(x))


def quality_warnings(data_statement, code_statement, n_data, n_code, data_license, code_license) -> Column:
    data_statement, code_statement, data_license, code_license = map(col, (data_statement, code_statement, data_license, code_license))
    n_links = col(n_data) + col(n_code)
    cut = lambda s: F.trim(s).rlike("https:?$")
    fused = lambda s: F.regexp_count(F.lower(s), F.lit("https?://")) > n_links + 1
    return F.array_compact(
        F.array(
            F.when(cut(data_statement), "data_statement_truncated_url"),
            F.when(cut(code_statement), "code_statement_truncated_url"),
            F.when(fused(data_statement), "data_fused_links_possible"),
            F.when(fused(code_statement), "code_fused_links_possible"),
            F.when((data_license != "") & (data_license == code_license), "identical_data_code_license"),
            F.when(data_license.startswith("CC-BY") & ~data_license.rlike(r"\d"), "data_license_missing_version"),
        )
    )


def is_pdf(content: Column | str) -> Column:
    return F.substring(col(content), 1, 5) == F.to_binary(F.lit("255044462D"), F.lit("hex"))


def has_extension(name: Column | str, extensions=("pdf",)) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*extensions)


def sanitize_filename(name: Column | str) -> Column:
    x = F.translate(F.coalesce(col(name), F.lit("")), "/\\\x00", "__")
    x = F.regexp_replace(x, "^[. ]+", "")
    ext = F.substring_index(x, ".", -1)
    stem = F.substr(x, F.lit(1), F.length(x) - F.length(ext) - 1)
    short = F.when(x.contains("."), F.concat(F.substring(stem, 1, 250), F.lit("."), F.substring(ext, 1, 10))).otherwise(F.substring(x, 1, 255))
    x = F.when(F.length(x) > 255, short).otherwise(x)
    return F.when(x == "", "unnamed.pdf").otherwise(x)


def basename(name: Column | str) -> Column:
    return F.substring_index(col(name), "/", -1)


def is_title(x: Column | str) -> Column:
    """For a text with single spaces: length, words, letters, no stop word, no journal header, no closing colon."""
    x = col(x)
    words = word_count(x)
    stop = r"(?i)\b(?:" + "|".join(TITLE_STOPWORDS) + r")\b"
    return ~x.rlike(JOURNAL_HEADER) & ~x.endswith(":") & F.length(x).between(8, 250) & words.between(2, 40) & ~x.rlike(stop) & (alpha_ratio(x) >= 0.4)


def percent(current: Column, total: Column) -> Column:
    """Rounded half to even; 0 without a total."""
    return F.when(total > 0, F.bround(current / total * 100, 0)).otherwise(0).cast("int")


def serves_model(name: Column | str, required: str) -> Column:
    """Whether a served model's name is the required one, with or without a tag."""
    name = col(name)
    return F.coalesce((name == required) | name.startswith(required + ":"), F.lit(False))


def duration_text(ms: Column | str) -> Column:
    s = F.floor(col(ms) / 1000)
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def position_text(n: Column | str) -> Column:
    n = col(n)
    return F.when(n == 1, "next").when(n == 2, "2nd").when(n == 3, "3rd").otherwise(F.concat(n.cast("string"), F.lit("th")))


def confidence(x: Column | str, base: float = 0.75) -> Column:
    """A number clamped to 0..1; base for anything else."""
    number = F.coalesce(F.when(F.lower(col(x).cast("string")).isin("true", "false"), (F.lower(col(x).cast("string")) == "true").cast("double")), col(x).try_cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(base)  # least() skips nulls
