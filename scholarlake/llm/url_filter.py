"""URL filter by character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are counted over all URLs that a rule decides. Counts are
exact: a table of (context, byte) windows of ORDER + 1 bytes, which grows with the input, holds the counts of all
shorter contexts as sums. A byte's probability starts uniform and is refined order by order with the context's counts
(interpolated smoothing); it sums up to 1 over all bytes. The decision is the length-normalised log-likelihood
difference against a threshold calibrated on rule-decided URLs that were held out of the counts.

Defined cases: null or URLs without `://` have empty host and path, match no rule and are scored by what text they have
(nothing scores 0); very long URLs are scored whole; without rule-decided URLs of both kinds every score is 0 and the
verdict allow; repeated rows are counted as often as they occur and judged alike; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarlake.llm.common import fold, frequent_from, lower_ascii, mapped, materialize, steps, table, texts

ORDER = 5
STRENGTH = 2.0
#: Windows that travel with the tasks, 16 bytes each.
CARRIED = 1 << 20
#: (action, host, path) of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and action; null without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _windows(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows, one for each byte of a URL and its end: ORDER bytes of context and the byte; and how many each URL has."""
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    raw = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    keys = np.zeros(max(0, len(raw) - ORDER), np.int64)
    for i in range(ORDER + 1):
        keys = keys << 8 | raw[i : len(raw) - ORDER + i]
    begins = np.cumsum(sizes + ORDER) - sizes - ORDER
    return keys[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n0, n1 (occurrences in rejected and accepted URLs that are counted) and hits (all occurrences), summed over some URLs."""
    for batch in batches:
        for part in steps(batch, "url", 1 << 20):
            keys, sizes = _windows(texts(part, "url"))
            good = np.repeat(np.array([-1 if x is None else x for x in part.column("good").to_pylist()], np.int8), sizes)
            found, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at[good == k], minlength=len(found)) for k in (0, 1)] + [np.bincount(at, minlength=len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(x.astype(np.int64)) for x in sums)], ["key", "n0", "n1", "hits"])


def window_counts(urls: DataFrame) -> DataFrame:
    """key, n0, n1, hits of all windows of urls: url, good (true: counted as accepted, false: as rejected, null: not counted)."""
    counted = urls.select(F.coalesce("url", F.lit("")).alias("url"), F.col("good").cast("int").alias("good")).mapInArrow(_count, "key long, n0 long, n1 long, hits long")
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "hits")))


def probabilities(windows: DataFrame) -> DataFrame:
    """key, p0, p1, hits: the probability of each window's last byte after the others under both models.

    Order by order, p(byte | context) = (n(context byte) + STRENGTH p(byte | shorter context)) / (n(context) + STRENGTH),
    where n(context) is the sum of n(context byte) over bytes, so each model sums up to 1 over all bytes."""
    lower = None
    for order in range(ORDER + 1):
        gram = F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        own = windows.groupBy(gram.alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("context", F.shiftright("gram", 8))
        sums = own.groupBy("context").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        rows = own.join(sums, "context")
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(lower.select(F.col("gram").alias("tail"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "tail")
        lower = rows.select("gram", *(((F.col(f"n{k}") + STRENGTH * F.col(f"q{k}")) / (F.col(f"c{k}") + STRENGTH)).alias(f"p{k}") for k in (0, 1)))
    return windows.select("key", "hits").join(lower.withColumnRenamed("gram", "key"), "key")


def train_url_model(decided: DataFrame, urls: DataFrame | None = None) -> DataFrame | None:
    """key, ratio (log p1 - log p0), hits for all windows of urls (url; those of decided if not given), learned from decided: url, good (boolean)."""
    kinds = {r.good for r in decided.select("good").distinct().collect()}
    if not {True, False} <= kinds:
        return None
    rows = decided.select("url", "good")
    if urls is not None:
        rows = rows.unionByName(urls.select("url", F.lit(None).cast("boolean").alias("good")))
    windows = materialize(window_counts(rows), "windows")
    return materialize(probabilities(windows).select("key", (F.log("p1") - F.log("p0")).alias("ratio"), "hits"), "ratios")


def score_urls(rows: DataFrame, model: DataFrame | None) -> DataFrame:
    """rows (with url) and url_score: the mean ratio over a URL's bytes and its end; 0 without a model and for empty URLs.

    The CARRIED most frequent windows travel with the tasks, which settles all but rare windows; those meet the model in a shuffled join."""
    if model is None:
        return rows.withColumn("url_score", F.lit(0.0))
    least = frequent_from(model, "hits", CARRIED)
    carried = model.where(F.col("hits") >= least).select("key", "ratio").toArrow()
    order = np.argsort(carried["key"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((carried["key"].to_numpy()[order], carried["ratio"].to_numpy()[order]))
    names = rows.columns
    more = [("url_no", T.LongType()), ("url_bytes", T.LongType()), ("url_sum", T.DoubleType()), ("url_rare", T.ArrayType(T.LongType()))]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(*x) for x in more)])
    numbered = rows.withColumn("url_no", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, ratio = shared.value
        keys, sizes = _windows(texts(batch, "url"))
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        begins = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(np.where(found, ratio[at] if len(known) else 0.0, 0.0), begins)
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat((~found).astype(np.int64), begins))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~found]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(sums), rare], [*batch.schema.names, "url_bytes", "url_sum", "url_rare"])

    scored = mapped(numbered, run, schema, "url", 1 << 20)
    if least:
        scored = materialize(scored, "scored")
        rest = model.where(F.col("hits") < least).select("key", "ratio")
        more = scored.select("url_no", F.explode("url_rare").alias("key")).join(rest, "key").groupBy("url_no").agg(F.sum("ratio").alias("more"))
        scored = scored.join(more, "url_no", "left").withColumn("url_sum", F.col("url_sum") + F.coalesce("more", F.lit(0.0)))
    score = F.when(F.coalesce(F.length("url"), F.lit(0)) > 0, F.col("url_sum") / F.col("url_bytes")).otherwise(0.0)
    return scored.select(*names, score.alias("url_score"))


def calibrated(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy over scored (good, url_score), from a histogram in 0.001 steps (at most 16,001 rows)."""
    score = F.col("url_score")
    place = F.round(1000 * F.greatest(F.lit(-8), F.least(F.lit(8), score))).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("bin").toArrow()
    good, bad = np.cumsum(np.array(bins["good"], float)), np.cumsum(np.array(bins["bad"], float))
    if not len(good) or not good[-1] or not bad[-1]:
        return 0.0
    at = int(np.argmax(bad / bad[-1] - good / good[-1]))
    edges = np.array(bins["bin"])
    return float(edges[at] + edges[min(at + 1, len(edges) - 1)]) / 2000


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, url_score of every row of pages (page_id, url)."""
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = (
        pages.select("page_id", F.col("url").cast("string").alias("url"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumns({"rule": rule, "action": action})
    )
    good, held_out = F.col("action") == "allow", F.coalesce(fold("page_id", 5) == 0, F.lit(False))
    decided = ruled.where("action IS NOT NULL").withColumn("good", good)
    model = train_url_model(decided.where(~held_out), ruled)
    scored = materialize(score_urls(ruled, model), "scored")
    cut = calibrated(scored.where(F.col("action").isNotNull() & held_out).select(good.alias("good"), "url_score")) if model else 0.0
    learned = F.when(F.col("url_score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", learned).alias("verdict"), "url_score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
