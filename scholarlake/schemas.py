"""Schemas of the stored tables."""

from __future__ import annotations

BLOCKS = "doc_id string, page int, col int, seq int, text string"
WORDS = "page_id int, word_id string, x0 double, x1 double, top double, bottom double, page_width double"
PARAGRAPHS = "doc_id string, idx int, label string, text string"
CONTEXTS = "doc_id string, kind string, rank int, points int, source string, idx int, text string"
LINKS = "doc_id string, pos int, url string, kind string"
REGISTRY = "doi string, title string, container_title string, issued_year int, source string"
PAPERS = (
    "doc_id string, title string, title_source string, doi string, doi_from_title_search boolean, data_statement string, data_status string, "
    "code_statement string, code_status string, data_license string, code_license string, data_links array<string>, code_links array<string>, "
    "confidences map<string,double>, warnings array<string>"
)
JOB_DOCUMENTS = (
    "doc_id string, job_id string, user_id string, filename string, content_type string, size_bytes bigint, sha256 string, status string, error string, "
    "created_at timestamp, updated_at timestamp"
)
JOBS = (
    "job_id string, user_id string, user_email string, status string, progress struct<current:int,total:int>, error string, created_at timestamp, "
    "updated_at timestamp, started_at timestamp, finished_at timestamp"
)
JOB_LOGS = (
    "log_id bigint, job_id string, ts timestamp, level string, op string, message string, doc_id string, filename string, duration_ms bigint, phase string, "
    "progress_current int, progress_total int, percent int, worker string, extra string"
)

DOCUMENT_STATES = ("uploaded", "queued", "processing", "done", "error")
JOB_STATES = ("pending", "running", "done", "error")
STATUSES = ("open", "restricted", "embedded", "future", "none")
