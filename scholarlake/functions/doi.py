"""DOIs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlake.config import DATASET_PREFIXES
from scholarlake.functions.text import col, jaccard, tokens

CANDIDATE = r'(?i)(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[^\s"<>]+)'
_CLEAN = r"10\.\d{4,9}/[A-Za-z0-9._\-/:]+"


def validate_doi(x: Column | str) -> Column:
    """The normalized DOI, or null."""
    x = F.trim(F.regexp_replace(F.trim(col(x)), r"^(?:doi:|DOI:|https?://(?:dx\.)?doi\.org/)", ""))
    head = F.trim(F.substring_index(x, "(", 1))
    x = F.when(x.contains("(") & head.rlike(f"^{_CLEAN}$"), head).otherwise(x)
    clean = F.regexp_extract(x, f"^({_CLEAN})", 1)
    x = F.regexp_replace(F.when(clean != "", clean).otherwise(x), r"[.,;)\]]+$", "")
    return F.when(x.rlike(r'^10\.\d{4,9}/[^\s"<>]+$'), x)


def first_doi(x: Column | str) -> Column:
    """The first DOI anywhere in a text, normalized."""
    found = F.regexp_extract(col(x), r'(?i)10\.\d{4,9}/[^\s"<>]+', 0)
    return validate_doi(F.when(found != "", found))


def is_dataset(doi: Column | str, prefixes=DATASET_PREFIXES, slash: bool = True) -> Column:
    doi = col(doi)
    return reduce(lambda a, b: a | b, [doi.startswith(p + "/" if slash else p) for p in prefixes])


def front_matter(x: Column | str, chars: int = 20_000) -> Column:
    """Text before a line that starts the references, at most `chars` characters."""
    return F.substring(F.regexp_replace(col(x), r"(?ims)^\s*(?:references|bibliography)\b.*", ""), 1, chars)


def candidates(x: Column | str, prefixes=DATASET_PREFIXES) -> Column:
    """Distinct valid article DOIs of a text in order."""
    found = F.transform(F.regexp_extract_all(col(x), F.lit(CANDIDATE), F.lit(1)), validate_doi)
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull() & ~is_dataset(d, prefixes)))


def score(text: Column | str, doi: Column | str) -> Column:
    """1.0 (0.6 beyond 5,000 characters), + 0.4 after `doi:`, + 0.3 in a doi.org URL."""
    text, doi = col(text), col(doi)
    at = F.instr(text, doi)
    before = F.substr(text, F.greatest(F.lit(1), at - 30), F.least(F.lit(30), at - 1))
    base = F.when((at > 0) & (at <= 5000), F.lit(1.0)).otherwise(F.lit(0.6))
    doi_label = F.when((at > 0) & before.rlike(r"(?i)doi:\s*$"), 0.4).otherwise(0.0)
    link = F.when((at > 0) & before.rlike(r"(?i)https?://(?:dx\.)?doi\.org/$"), 0.3).otherwise(0.0)
    return F.round(base + doi_label + link, 3)


def doi_key(x: Column | str) -> Column:
    """A DOI as registries are joined by it: lower case, without the resolver's address that some put before it."""
    return F.regexp_replace(F.lower(F.trim(col(x))), r"^https://doi\.org/", "")


def doi_href(x: Column | str) -> Column:
    x = F.trim(col(x))
    return F.when(x.startswith("10."), F.concat(F.lit("https://doi.org/"), x)).otherwise(x)


def reconcile(doi: Column, confidence: Column, record_similarity: Column, found: Column, similarity: Column) -> Column:
    """struct<doi, confidence, replaced> from the paper's DOI, its record's title similarity (null: no record) and the
    best title search result."""
    sim, own = F.coalesce(similarity, F.lit(0.0)), F.coalesce(record_similarity, F.lit(0.0))
    weak = record_similarity.isNull() | (record_similarity < 0.2)
    better = found.isNotNull() & (confidence < 0.9) & (sim >= F.greatest(F.lit(0.6), own + 0.25))
    out = lambda d, c, r: F.struct(d.alias("doi"), c.cast("double").alias("confidence"), F.lit(r).alias("replaced"))
    return (
        F.when(doi.isNull() & found.isNotNull() & (sim >= 0.4), out(found, F.least(F.lit(1.0), sim + 0.6), True))
        .when(doi.isNull(), out(doi, F.lit(None), False))
        .when(weak & better, out(found, F.least(F.lit(1.0), sim + 0.55), True))
        .when(weak, out(doi, F.greatest(confidence * 0.7, F.lit(0.3)), False))
        .otherwise(out(doi, F.least(F.lit(1.0), confidence + 0.2 + own), False))
    )


def title_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(tokens(a), tokens(b))
