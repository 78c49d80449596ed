"""Registered queries over the driver's tables: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions import doi as D
from scholarlake.functions import records as R
from scholarlake.functions import text as T
from scholarlake.functions import urls as U
from scholarlake.operators import answers, jobs, layout, papers, retrieval
from scholarlake.plans.views import table, view
from scholarlake.sources.states import States, scratch
from scholarlake.streaming import logs as windows
from scholarlake.streaming import worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


#: Positions and counts that are longs in results, as SQL has them.
_LONGS = {"ordinal", "idx", "rank", "n_links", "pos", "chunk", "data_links", "code_links"}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if c in _LONGS and kind == "int"})

    QUERIES[fn.__name__] = run
    return fn


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers_view")


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).where("seq = 1").select("doc_id", F.col("text").alias("title"))


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    return papers.rank_contexts(papers.segment(_blocks(spark, sf)))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return papers.grouped_contexts(papers.segment(_blocks(spark, sf)))


@query
def validate_doi(spark, sf):
    return _blocks(spark, sf).where("seq = 2").select("doc_id", F.col("text").alias("raw"), D.validate_doi("text").alias("doi"))


@query
def doi_candidates_scored(spark, sf):
    return papers.doi_candidates(_blocks(spark, sf))


@query
def doi_best_per_paper(spark, sf):
    return papers.best_doi(papers.doi_candidates(_blocks(spark, sf)))


@query
def doi_registry_verify(spark, sf):
    best = papers.best_doi(papers.doi_candidates(_blocks(spark, sf)))
    return papers.verify_doi(best, _titles(spark, sf), view(spark, sf, "registry_view"))


@query
def title_similarity_best_match(spark, sf):
    return papers.best_registry_match(_titles(spark, sf), view(spark, sf, "registry_view")).select("doc_id", "doi", F.round("similarity", 6).alias("similarity"), "source")


@query
def heuristic_title(spark, sf):
    return papers.heuristic_title(_blocks(spark, sf))


@query
def resolved_title(spark, sf):
    return papers.resolved_title(_blocks(spark, sf))


@query
def segment_paragraphs(spark, sf):
    return papers.segment(_blocks(spark, sf))


@query
def rank_contexts_topk(spark, sf):
    return _contexts(spark, sf)


@query
def availability_statement(spark, sf):
    return papers.statements(_grouped(spark, sf)).drop("contexts")


@query
def availability_status(spark, sf):
    return papers.availability(_blocks(spark, sf)).select("doc_id", "kind", F.size("links").alias("n_links"), "status")


@query
def extract_links(spark, sf):
    return papers.paper_links(_grouped(spark, sf))


@query
def classify_links(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.inspected("url").alias("url"))
    found = _blocks(spark, sf).select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s)]+)"), F.lit(1))).alias("url"))
    urls = pages.unionByName(found.select("id", U.inspected("url").alias("url"))).where("url IS NOT NULL")
    return urls.distinct().select("id", "url", U.link_kind("url").alias("kind"))


@query
def url_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(U.domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_if(U.is_url("url")).alias("valid"))


@query
def url_repair(spark, sf):
    return _blocks(spark, sf).where("contains(text, 'http')").select("doc_id", "seq", U.glue_host("text").alias("text"))


@query
def layout_url_repair(spark, sf):
    return _blocks(spark, sf).where("contains(text, 'http')").select("doc_id", "seq", U.layout_urls("text").alias("text"))


@query
def layout_clean_paragraphs(spark, sf):
    parts = _blocks(spark, sf).select("doc_id", "seq", F.posexplode(T.split_simple("text")).alias("pos", "part"))
    return parts.select("doc_id", "seq", "pos", U.clean_paragraph("part").alias("text")).where("text <> ''")


@query
def sanitize_filename(spark, sf):
    return view(spark, sf, "docs_view").select("doc_id", R.sanitize_filename("filename").alias("safe"), F.lower(R.basename("filename")).alias("base"))


@query
def file_gate(spark, sf):
    return view(spark, sf, "docs_view").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(R.has_extension("filename")).alias("pdf"), F.count_if(F.col("size_bytes") <= 50_000).alias("small")
    )


@query
def pdf_magic_gate(spark, sf):
    content = F.when(F.col("n_data_links") > 0, F.lit("%PDF-1.7 ")).otherwise(F.lit("plain text")).cast("binary")
    return view(spark, sf, "docs_view").groupBy("status", "n_code_links").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.is_pdf(content)).alias("pdf"))


def _license_lines(spark, sf):
    line = r"(?im)^[^\n]*(?:license|licence|creative commons|cc[- ]by|cc0)[^\n]*$"
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(0))).alias("line"))


@query
def license_normalize(spark, sf):
    return _license_lines(spark, sf).select("doc_id", "line", R.normalize_license("line").alias("license"))


@query
def license_rollup(spark, sf):
    return license_normalize(spark, sf).groupBy("license").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query
def quality_warnings(spark, sf):
    rows = papers.availability(_blocks(spark, sf)).groupBy("doc_id").agg(
        *(F.max(F.when(F.col("kind") == k, F.col("statement"))).alias(f"{k}_statement") for k in ("data", "code")),
        *(F.max(F.when(F.col("kind") == k, F.size("links"))).alias(f"n_{k}") for k in ("data", "code")),
    )
    rows = rows.withColumns({"data_license": F.when(F.col("doc_id") % 2 == 0, "CC-BY").otherwise("CC-BY-4.0"), "code_license": F.lit("MIT")})
    return rows.select("doc_id", F.explode(R.quality_warnings("data_statement", "code_statement", "n_data", "n_code", "data_license", "code_license")).alias("warning"))


@query
def dehyphenate_and_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse(T.dehyphenate("text")).alias("text"))


@query
def split_simple(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_simple("text")).alias("pos", "text"))


@query
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query
def spaced_letter_compaction(spark, sf):
    spaced = F.regexp_replace("text", r"([A-Za-z])(?=[A-Za-z])", "$1 ")
    return _blocks(spark, sf).select("doc_id", "seq", T.compact_letters(spaced).alias("text"))


@query
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("text"))


@query
def content_sha256_duplicates(spark, sf):
    sums = table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return sums.where("n > 1")


@query
def text_blocks_meta(spark, sf):
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    single = F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$")))
    first = F.col("page") == 1
    return _blocks(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(first).alias("first_page_blocks"),
        F.countDistinct(F.when(first, F.col("col"))).alias("first_page_columns"),
        F.substring(F.min_by("text", "seq"), 1, 200).alias("preview"),
        F.round(F.sum(single) / F.nullif(F.sum(F.size(tokens)), F.lit(0)), 6).alias("singletons"),
    )


@query
def chunk_documents(spark, sf):
    return retrieval.chunk_documents(table(spark, sf, "documents"))


@query
def chunk_documents_recursive(spark, sf):
    return retrieval.chunk_documents(table(spark, sf, "documents"), recursive=True)


@query
def vector_topk_within(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = retrieval.nearest_within(vectors, vectors.where("vec_id % 100 = 0"), key="label")
    return found.select("label", "query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def context_concat_capped(spark, sf):
    return retrieval.capped_context(_blocks(spark, sf).where("text <> ''").select("doc_id", F.col("seq").alias("ord"), "text"), 300)


def _lines(spark, sf):
    return layout.with_lines(layout.with_columns(view(spark, sf, "words_view")))


@query
def layout_columns(spark, sf):
    return layout.column_splits(view(spark, sf, "words_view"))


@query
def layout_lines(spark, sf):
    return _lines(spark, sf).groupBy("page_id", "col", "line").agg(F.count(F.lit(1)).alias("words"), F.min("top").alias("top"))


@query
def layout_tokens(spark, sf):
    return layout.tokens(_lines(spark, sf))


@query
def layout_paragraphs(spark, sf):
    return layout.paragraphs(_lines(spark, sf))


@query
def layout_line_text(spark, sf):
    return layout.line_text(_lines(spark, sf)).select("page_id", "col", "line", "text")


@query
def layout_text(spark, sf):
    return layout.paragraph_text(_lines(spark, sf))


@query
def llm_response_parse(spark, sf):
    rows = _blocks(spark, sf).where("seq = 5")
    part = F.struct(F.when(F.col("k").isin(0, 2), "present").otherwise("absent").alias("verdict"), F.col("text").alias("raw_quote"), F.col("text").alias("clean_statement"), F.lit(0.9).alias("confidence"))
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct(part.alias("data"))), F.lit(" Done."))
    found = answers.grounded(answers.parse_answer(reply), F.array("text"), "data")
    return rows.select("doc_id", found.alias("f")).select("doc_id", "f.statement", "f.confidence")


@query
def llm_prompts(spark, sf):
    return answers.build_prompt(_contexts(spark, sf))


def _listing(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "user_id", "status", "created_at")


@query
def list_jobs_newest(spark, sf):
    return _listing(jobs.newest_jobs(view(spark, sf, "jobs_view")))


@query
def list_user_jobs(spark, sf):
    return _listing(jobs.newest_jobs(view(spark, sf, "jobs_view"), user_id=7))


@query
def list_pending(spark, sf):
    return _listing(jobs.pending_jobs(view(spark, sf, "jobs_view")))


@query
def queue_position(spark, sf):
    return jobs.queue_positions(view(spark, sf, "jobs_view"))


@query
def promote_next_job(spark, sf):
    return jobs.promote(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"))


@query
def claim_next_document(spark, sf):
    return jobs.claim_next(view(spark, sf, "docs_view"))


@query
def job_progress(spark, sf):
    return jobs.job_progress(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"))


@query
def jobs_to_finalize(spark, sf):
    return jobs.to_finalize(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"))


@query
def jobless_documents(spark, sf):
    return jobs.jobless(view(spark, sf, "docs_view"), view(spark, sf, "jobs_view").where("status <> 'error'")).select("doc_id", "job_id")


@query
def job_detail(spark, sf):
    return jobs.job_detail(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"))


def _in_state(spark, sf, *states):
    return view(spark, sf, "jobs_view").where(F.col("status").isin(*states)).select("job_id")


@query
def cancel_job(spark, sf):
    return jobs.cancel(view(spark, sf, "docs_view"), _in_state(spark, sf, "pending", "running")).select("doc_id", "job_id", "status", "error")


@query
def rerun_job(spark, sf):
    return jobs.rerun(view(spark, sf, "docs_view"), view(spark, sf, "jobs_view"), _in_state(spark, sf, "error"), 100_000_000)


@query
def delete_job(spark, sf):
    return jobs.delete_jobs(view(spark, sf, "docs_view"), _in_state(spark, sf, "done")).select("doc_id", "job_id")


@query
def cancel_job_rows(spark, sf):
    return jobs.cancel_jobs(view(spark, sf, "jobs_view"), _in_state(spark, sf, "pending", "running")).select("job_id", "status", "error")


@query
def rerun_job_rows(spark, sf):
    return jobs.rerun_jobs(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"), _in_state(spark, sf, "error"), 100_000_000, "2024-06-01 00:00:00")


@query
def delete_job_rows(spark, sf):
    return jobs.delete_jobs(view(spark, sf, "jobs_view"), _in_state(spark, sf, "done")).select("job_id", "status")


@query
def job_op_sequence(spark, sf):
    return jobs.op_sequence(view(spark, sf, "logs_view"))


@query
def log_download(spark, sf):
    rows = jobs.log_download(view(spark, sf, "jobs_view"), view(spark, sf, "logs_view"))
    return rows.select("job_id", "log_id", *(F.get_json_object("value", f"$.{c}").alias(c) for c in ("op", "info")))


@query
def list_jobs_admin(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return jobs.listing(view(spark, sf, "jobs_view"), users).select("job_id", "status", "user_id", "created_by.email", "queue_position", "duration_ms")


@query
def workflow_report(spark, sf):
    whole = view(spark, sf, "docs_view").groupBy("job_id").agg(F.bool_and(F.col("title").isNotNull()).alias("t"), F.bool_and(F.col("doi").isNotNull()).alias("d"))
    rows = view(spark, sf, "jobs_view").join(whole, "job_id", "left")
    ms = jobs.duration_ms(F.col("started_at"), F.col("finished_at"))
    return jobs.workflow_report(rows.select("user_id", (F.col("status") == "done").alias("success"), ms.alias("duration_ms"), jobs.all_checks(F.col("t"), F.col("d")).alias("accurate")), ("user_id",))


@query
def status_fold(spark, sf):
    return jobs.fold_states(view(spark, sf, "logs_view"), "job_id", "op")


@query
def status_fold_incremental(spark, sf):
    """status_fold() over the log as it came in three batches: each is folded once and merged with what was there."""
    logs = view(spark, sf, "logs_view")
    first, last = logs.agg(F.min("ts"), F.max("ts")).first()
    states = States(scratch(spark, "states"), "job_id", "op", buckets=8, compact_every=2)
    if first is None:
        return jobs.fold_states(logs, "job_id", "op")
    cuts = [first + (last - first) * i / 3 for i in (1, 2)]
    for batch, (after, upto) in enumerate(((None, cuts[0]), cuts, (cuts[1], None))):
        part = logs if after is None else logs.where(F.col("ts") > F.lit(after).cast("timestamp_ntz"))
        states.advance(part if upto is None else part.where(F.col("ts") <= F.lit(upto).cast("timestamp_ntz")), batch)
    return states.read(spark)


@query
def job_logs_page(spark, sf):
    return jobs.log_page(view(spark, sf, "logs_view"), after=("2024-01-10 00:00:00", 0)).select("log_id", "job_id", "ts", "op")


@query
def job_logs_page_desc(spark, sf):
    return jobs.log_page(view(spark, sf, "logs_view"), descending=True).select("log_id", "job_id", "ts", "op")


@query
def job_log_rollup(spark, sf):
    rows = jobs.log_rollup(view(spark, sf, "jobs_view"), view(spark, sf, "logs_view"))
    return rows.withColumn("error_log_tail", F.array_join(F.transform("error_log_tail", lambda x: x.cast("string")), ","))


@query
def job_quality_rollup(spark, sf):
    rows = jobs.quality_rollup(view(spark, sf, "docs_view"))
    return rows.withColumns({c: F.round(c, 6) for c in ("confidence_p25", "confidence_p75")})


@query
def export_csv_rows(spark, sf):
    return jobs.export_rows(view(spark, sf, "jobs_view"), view(spark, sf, "docs_view"))


@query
def export_ndjson_rows(spark, sf):
    return jobs.ndjson(view(spark, sf, "logs_view"))


@query
def logs_tumbling(spark, sf):
    return windows.tumbling(view(spark, sf, "logs_view"))


@query
def logs_session(spark, sf):
    return windows.sessions(view(spark, sf, "logs_view"))


@query
def registry_cache_distinct(spark, sf):
    return worker.first_lookups(validate_doi(spark, sf).where("doi IS NOT NULL")).select("key")


@query
def paper_record(spark, sf):
    rows = papers.paper_records(_blocks(spark, sf), view(spark, sf, "registry_view"))
    return rows.select("doc_id", "title", "doi", "doi_from_title_search", "data_statement", "code_statement", "data_status", "code_status", F.size("data_links").alias("data_links"), F.size("code_links").alias("code_links"))


@query
def export_records(spark, sf):
    return jobs.export_records(papers.paper_records(_blocks(spark, sf), view(spark, sf, "registry_view")))


@query
def export_documents(spark, sf):
    return jobs.export_documents(view(spark, sf, "runs_view"), papers.paper_records(_blocks(spark, sf), view(spark, sf, "registry_view")))
