"""The job, document and log store: queue, progress, transitions, rollups. Keys are job_id and doc_id.

State is a snapshot table or, preferably, an append-only event log folded to the latest state of each key.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.functions import records as R

FINISHED = ("done", "error")
OPEN = ("queued", "processing")
OPEN_OR_UPLOADED = ("queued", "processing", "uploaded")
CANCELLED = "Cancelled by user"


def newest_jobs(jobs: DataFrame, limit: int = 100, user_id=None, status: str | None = None) -> DataFrame:
    if user_id is not None:
        jobs = jobs.where(F.col("user_id") == user_id)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def is_admin(email: Column, admins: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(email)).isin(*(a.strip().lower() for a in admins)), F.lit(False)) if admins else F.lit(False)


def owned(rows: DataFrame, user_id, admin: bool = False) -> DataFrame:
    """Rows that a user may see: their own; all of them for an admin."""
    return rows if admin else rows.where(F.col("user_id") == user_id)


def pending_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(limit)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """job_id, created_at, queue_position: 1 + pending jobs created strictly earlier.

    Counted by creation time first and accumulated over day totals, so no task sees all pending jobs: within a day by
    a window, across days over one row a day.
    """
    pending = jobs.where("status = 'pending'").select("job_id", "created_at", F.to_date("created_at").alias("day"))
    times = pending.groupBy("day", "created_at").agg(F.count(F.lit(1)).alias("n"))
    days = times.groupBy("day").agg(F.sum("n").alias("n"))
    before_day = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("days_before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = times.select("day", "created_at", inside.alias("inside")).join(before_day, "day")
    return pending.join(ahead, ["day", "created_at"]).select("job_id", "created_at", (F.col("days_before") + F.col("inside") + 1).alias("queue_position"))


def counts(docs: DataFrame) -> DataFrame:
    """job_id, total, current, remaining, percent of each job's documents."""
    done = F.count_if(F.col("status").isin(*FINISHED))
    return docs.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), done.alias("current"), F.count_if(F.col("status").isin(*OPEN)).alias("remaining")).withColumn("percent", R.percent(F.col("current"), F.col("total")))


def job_progress(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    rows = jobs.select("job_id", "status").join(counts(docs), "job_id", "left")
    return rows.select("job_id", "status", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "current", "remaining", "percent")))


def duration_ms(start: Column, end: Column) -> Column:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000)


def job_detail(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    rows = job_progress(jobs, docs).join(jobs.select("job_id", "started_at", "finished_at", "error"), "job_id")
    return rows.select("job_id", "status", "total", "current", "percent", duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"), "error")


def to_finalize(jobs: DataFrame, docs: DataFrame, remaining=OPEN_OR_UPLOADED) -> DataFrame:
    """Running jobs that have documents, none of them unfinished."""
    some = docs.select("job_id").distinct()
    left = docs.where(F.col("status").isin(*remaining)).select("job_id")
    return jobs.where("status = 'running'").join(some, "job_id", "left_semi").join(left, "job_id", "left_anti").select("job_id")


def jobless(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued documents without a job."""
    return docs.where("status = 'queued'").join(jobs.select("job_id"), "job_id", "left_anti")


def promote(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """job_id of the oldest pending job, if no job runs or none that runs has documents left."""
    busy = jobs.where("status = 'running'").join(docs.where(F.col("status").isin(*OPEN)).select("job_id"), "job_id", "left_semi").limit(1).select(F.lit(1).alias("busy"))
    first = jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(1).select("job_id", "created_at")
    return first.join(F.broadcast(busy), F.lit(True), "left_anti")


def claim_next(docs: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """For each job (with jobs: each running one) the oldest queued document."""
    rows = docs.where("status = 'queued'")
    if jobs is not None:
        rows = rows.join(jobs.where("status = 'running'").select("job_id"), "job_id", "left_semi")
    return rows.groupBy("job_id").agg(F.min(F.struct("created_at", "doc_id")).alias("f")).select("job_id", "f.doc_id", "f.created_at")


def cancel(docs: DataFrame, job_ids: DataFrame) -> DataFrame:
    """docs with unfinished documents of the given jobs set to error."""
    return _cancelled(docs, job_ids, F.col("status").isin(*OPEN_OR_UPLOADED))


def cancel_jobs(jobs: DataFrame, job_ids: DataFrame) -> DataFrame:
    """jobs with the given ones set to error."""
    return _cancelled(jobs, job_ids, F.lit(True))


def _cancelled(rows: DataFrame, job_ids: DataFrame, stoppable: Column) -> DataFrame:
    """Earlier errors of other rows stay."""
    marked = rows.join(job_ids.select("job_id").distinct().withColumn("hit", F.lit(True)), "job_id", "left")
    stop = F.coalesce(F.col("hit") & stoppable, F.lit(False))
    before = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return marked.withColumn("error", F.when(stop, CANCELLED).otherwise(before)).withColumn("status", F.when(stop, "error").otherwise(F.col("status"))).drop("hit")


def _finished(jobs: DataFrame, job_ids: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*FINISHED)).join(job_ids, "job_id", "left_semi")


def rerun(docs: DataFrame, jobs: DataFrame, job_ids: DataFrame, offset: int, suffix: str = "-r") -> DataFrame:
    """Copies of finished jobs' documents for new jobs (id + offset): queued again, without results. A second rerun of
    the same job takes another offset and suffix."""
    done = _finished(jobs, job_ids).select("job_id")
    return docs.join(done, "job_id", "left_semi").select((F.col("job_id") + offset).alias("job_id"), F.concat(F.col("doc_id"), F.lit(suffix)).alias("doc_id"), "filename", "size_bytes", F.lit("queued").alias("status"))


def rerun_jobs(jobs: DataFrame, docs: DataFrame, job_ids: DataFrame, offset: int, now) -> DataFrame:
    """The new jobs of rerun(): pending, created now, with the number of their documents; none for jobs without documents."""
    total = docs.join(job_ids, "job_id", "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    return _finished(jobs, job_ids).join(total, "job_id").select(
        (F.col("job_id") + offset).alias("job_id"), F.col("job_id").alias("original_job_id"), "user_id", F.lit("pending").alias("status"), F.lit(now).cast("timestamp").alias("created_at"), "total"
    )


def delete_jobs(rows: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Rows of jobs or documents without the given jobs; logs are kept by not calling this on them."""
    return rows.join(job_ids.select("job_id"), "job_id", "left_anti")


def fold_states(events: DataFrame, key: str, state: str, order=("ts", "log_id"), final=()) -> DataFrame:
    """Latest state of each key; a state in `final` is not left again."""
    place = F.struct(*order)
    last = F.max_by(F.col(state), place)
    if final:
        last = F.coalesce(F.min_by(F.when(F.col(state).isin(*final), F.col(state)), F.when(F.col(state).isin(*final), place)), last)
    return events.groupBy(key).agg(last.alias(state), F.max(order[0]).alias("at"), F.count(F.lit(1)).alias("events"))


# --- logs


def since(text: str) -> datetime.datetime:
    """An ISO 8601 time as UTC without a zone, as logs have it; a time without an offset is UTC. Anything else is a ValueError."""
    at = datetime.datetime.fromisoformat(text)
    return at.astimezone(datetime.timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def log_page(logs: DataFrame, limit: int = 1000, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next page after (ts, log_id), in that order; a time alone is inclusive. Times may be ISO strings with an offset."""
    if after is not None:
        after = (since(after[0]) if isinstance(after[0], str) else after[0], *after[1:])
        ts, log_id = F.lit(after[0]).cast(logs.schema["ts"].dataType), after[1] if len(after) > 1 else None
        if log_id is None:
            logs = logs.where(F.col("ts") <= ts if descending else F.col("ts") >= ts)
        elif descending:
            logs = logs.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("log_id") < log_id)))
        else:
            logs = logs.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("log_id") > log_id)))
    order = [F.desc("ts"), F.desc("log_id")] if descending else ["ts", "log_id"]
    return logs.orderBy(*order).limit(min(limit, 2000))


def log_rollup(jobs: DataFrame, logs: DataFrame, tail: int = 5) -> DataFrame:
    """One row a job, also without logs: counts, first error, last operation and the last errors."""
    error = F.col("level") == "error"
    place = F.struct("ts", "log_id")
    late = F.row_number().over(Window.partitionBy("job_id", "level").orderBy(F.desc("ts"), F.desc("log_id")))
    last_errors = logs.where(error).withColumn("n", late).where(F.col("n") <= tail).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ts", "log_id"))).alias("t"))
    last_errors = last_errors.select("job_id", F.transform("t", lambda x: x["log_id"]).alias("error_log_tail"))
    sums = logs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(error).alias("error_logs_count"),
        F.min_by(F.when(error, F.col("log_id")), F.when(error, place)).alias("first_error"),
        F.max_by("op", place).alias("last_phase"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = jobs.select("job_id", F.col("error").alias("job_error_field")).join(sums, "job_id", "left").join(last_errors, "job_id", "left")
    return rows.select("job_id", "job_error_field", zero("total_logs"), zero("error_logs_count"), "first_error", "last_phase", F.coalesce("error_log_tail", F.array().cast("array<bigint>")).alias("error_log_tail"))


def op_sequence(logs: DataFrame) -> DataFrame:
    """job_id, pos, op: each job's operations in order, a row each, since a job's log may be long.

    Rows are numbered within an hour of a job, and hours by running sums over their counts, so a long log is not one task's."""
    rows = logs.select("job_id", "op", "ts", "log_id", F.date_trunc("hour", "ts").alias("hour"))
    hours = rows.groupBy("job_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("job_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("job_id", "hour").orderBy("ts", "log_id"))
    r, h = rows.withColumn("inside", inside).alias("r"), hours.withColumn("before", before).alias("h")
    return r.join(h, F.expr("r.job_id <=> h.job_id AND r.hour <=> h.hour")).select("r.job_id", (F.col("before") + F.col("inside") - 1).alias("pos"), "op")


def log_download(jobs: DataFrame, logs: DataFrame, descending: bool = False, page: int = 1000) -> DataFrame:
    """job_id, ts, log_id, value: the NDJSON lines of each job, to be written in order of (ts, log_id); descending, the
    last page alone. A job without logs has one line that says so."""
    rows = logs.join(jobs.select("job_id"), "job_id", "left_semi")
    if descending:
        place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("log_id")))
        rows = rows.withColumn("place", place).where(F.col("place") <= page).drop("place")
    lines = rows.select("job_id", "ts", "log_id", F.to_json(F.struct(*logs.columns)).alias("value"))
    none = jobs.select("job_id").join(logs.select("job_id"), "job_id", "left_anti")
    said = F.to_json(F.struct(F.col("job_id").cast("string").alias("job_id"), F.lit("no logs available").alias("info")))
    return lines.unionByName(none.select("job_id", said.alias("value")), allowMissingColumns=True)


def listing(jobs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """jobs with duration_ms and, if pending, queue_position; for an admin, who passes users (user_id, email), also created_by."""
    rows = jobs.join(queue_positions(jobs).select("job_id", "queue_position"), "job_id", "left")
    rows = rows.withColumn("duration_ms", duration_ms(F.col("started_at"), F.col("finished_at")))
    if users is None:
        return rows
    return rows.join(users.select("user_id", "email"), "user_id", "left").withColumn("created_by", F.struct("user_id", "email")).drop("email")


# --- rollups and exports


def all_checks(*checks: Column) -> Column:
    """Whether there are checks and every one is true."""
    out = F.lit(bool(checks))
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def workflow_report(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """runs (success, duration_ms, accurate) by the given columns: counts, rates in percent, durations of the successful ones."""
    good = F.coalesce(F.col("success"), F.lit(False))
    accurate = F.count_if(good & F.coalesce(F.col("accurate"), F.lit(False)))
    ms = F.when(good, F.col("duration_ms"))
    share = lambda n, of: F.round(n * 100 / F.nullif(of, F.lit(0)), 1)
    total, done = F.count(F.lit(1)), F.count_if(good)
    return runs.groupBy(*by).agg(
        total.alias("total"), done.alias("successful"), (total - done).alias("failed"), share(done, total).alias("success_rate"),
        F.round(F.avg(ms), 3).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), accurate.alias("accurate"), share(accurate, done).alias("accuracy_rate"),
    )


def counted_quantiles(rows: DataFrame, key: str, value: str, at: dict[str, float], bins: int = 4_096) -> DataFrame:
    """key and a column for each quantile q in `at`: the value at place floor(q * (n - 1)) of the key's sorted values, nulls left out.

    Exact, by selection over counts: values are counted before they meet, a key's counts are summed in bins of its range, and
    running sums over at most `bins` rows tell in which bin a place is; only the distinct values of that bin are put in order.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    counted = values.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    spans = counted.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("all_"))
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    c, s = counted.alias("c"), spans.alias("s")
    binned = c.join(s, F.expr("c.key <=> s.key")).select("c.*", "low", "high", "all_")
    binned = binned.withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int"))
    bins_ = binned.groupBy("key", "bin").agg(F.sum("n").alias("inside"), F.max("all_").alias("all_"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.lit(q) * (F.col("all_") - 1)).alias("place")) for name, q in at.items()))).alias("w")
    found = bins_.withColumn("before", before).select("key", "bin", "before", "inside", wanted).select("key", "bin", "before", "inside", "w.*")
    found = found.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("inside"))).drop("inside")
    b, f = binned.alias("b"), found.alias("f")
    inside = b.join(f, F.expr("b.key <=> f.key AND b.bin = f.bin")).select("b.key", "value", "n", "name", "before", "place")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    first = inside.withColumn("upto", upto).where(F.col("upto") > F.col("place"))
    return first.groupBy(F.col("key").alias(key)).agg(*(F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in at))


def quality_rollup(docs: DataFrame) -> DataFrame:
    """Counts, missing fields and confidence quartiles (the value at floor(q * (n - 1)) of the sorted list) of each job."""
    done = F.col("status") == "done"
    quartiles = counted_quantiles(docs.where(done), "job_id", "confidence", {"confidence_p25": 0.25, "confidence_p75": 0.75})
    sums = docs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(F.col("status") == "error").alias("error_docs"),
        F.count_if(done).alias("analyzed_docs"),
        F.count_if(done & F.col("title").isNull()).alias("missing_title"),
        F.count_if(done & F.col("doi").isNull()).alias("missing_doi"),
        F.count_if(done & (F.col("n_data_links") == 0)).alias("empty_data_links"),
        F.count_if(done & (F.col("n_code_links") == 0)).alias("empty_code_links"),
        F.round(F.avg(F.when(done, F.col("confidence"))), 6).alias("confidence_mean"),
    )
    if "error" in docs.columns:
        place = F.when(F.col("error").isNotNull(), F.struct("created_at", "doc_id"))
        sums = sums.join(docs.groupBy("job_id").agg(F.min_by("error", place).alias("sample_error")), "job_id")
    return sums.join(quartiles, "job_id", "left")


def export_rows(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """The CSV export of finished documents: nulls are empty, links joined by `; ` with their counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.where(F.col("status").isin(*FINISHED)).join(jobs.select("job_id"), "job_id", "left_semi")
    return rows.select("job_id", "doc_id", F.coalesce(F.nullif(R.basename("filename"), F.lit("")), F.lit("unknown.pdf")).alias("filename"), text("title"), text("doi"), F.col("n_data_links").alias("data_links_count"), F.col("n_code_links").alias("code_links_count"))


def export_records(records: DataFrame) -> DataFrame:
    """paper_records() in the export's columns and order."""
    from scholarlake.config import EXPORT_COLUMNS

    links = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
    held = {
        "source_file": F.col("doc_id").cast("string"), "filename": F.coalesce(F.nullif(R.basename("filename"), F.lit("")), F.lit("unknown.pdf")) if "filename" in records.columns else F.lit("unknown.pdf"),
        "title": F.col("title"), "title_source": F.col("title_source"), "doi": F.col("doi"),
        "doi_from_title_search": F.when(F.col("doi_from_title_search"), "true"),
        "data_availability_statement": F.col("data_statement"), "code_availability_statement": F.col("code_statement"),
        "data_links_count": F.size("data_links").cast("string"), "code_links_count": F.size("code_links").cast("string"),
        "data_links": links("data_links"), "code_links": links("code_links"),
    }
    return records.select(*(F.coalesce(held.get(c, F.lit(None).cast("string")), F.lit("")).alias(c) for c in EXPORT_COLUMNS))


def export_documents(docs: DataFrame, records: DataFrame) -> DataFrame:
    """The export of finished documents (job_id, doc_id, filename, status, error) with their paper_records(): job_id and the
    export's columns in order; nulls are empty, links joined by `; `. A document without a record has its file and error."""
    from scholarlake.config import EXPORT_COLUMNS

    none = F.lit(None).cast("string")
    rows = docs.where(F.col("status").isin(*FINISHED)).select("job_id", "doc_id", "filename", "error").join(records, "doc_id", "left")
    file = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit("unknown.pdf"))
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)).cast("string")
    links = lambda c: F.array_join(F.col(c), "; ")
    held = {
        "source_file": file, "filename": R.basename(file), "title": F.col("title"), "title_source": F.when(F.col("title").isNotNull(), F.col("title_source")), "doi": F.col("doi"),
        "doi_from_title_search": F.when(F.col("doi_from_title_search"), "true"),
        "data_availability_statement": F.col("data_statement"), "code_availability_statement": F.col("code_statement"),
        "data_sharing_license": F.col("data_license") if "data_license" in records.columns else none, "code_license": F.col("code_license") if "code_license" in records.columns else none,
        "data_links_count": n("data_links"), "code_links_count": n("code_links"), "data_links": links("data_links"), "code_links": links("code_links"), "error": F.col("error"),
    }
    return rows.select("job_id", *(F.coalesce(held[c], F.lit("")).alias(c) for c in EXPORT_COLUMNS))


def ndjson(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))
