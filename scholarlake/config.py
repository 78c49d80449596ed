"""Settings of the engine. Each value can be replaced: Settings(max_contexts=4)."""

from __future__ import annotations

from dataclasses import dataclass

# Domains, prefixes, headings and phrases that decide results.
DATA_DOMAINS = (
    "zenodo.org", "figshare.com", "datadryad.org", "dryad.org", "osf.io", "pangaea.de", "data.mendeley.com", "openneuro.org", "dataverse.org",
    "purl.org", "ebi.ac.uk", "ncbi.nlm.nih.gov", "ega-archive.org",
)
CODE_DOMAINS = ("github.com", "gitlab.com", "gitlab.org", "bitbucket.org", "codeocean.com", "sourceforge.net", "codeberg.org", "huggingface.co")
DENIED = ("orcid.org", "urldefense.com", "terms-and-conditions", "onlinelibrary.wiley.com/terms", "publons.com", "doubleclick.net")
DATASET_PREFIXES = ("10.5281", "10.6084", "10.5061", "10.17605", "10.1594", "10.7910", "10.18112")
DATA_HEADINGS = (
    "data availability", "availability of data", "data and materials availability", "data accessibility", "availability of supporting data",
)
CODE_HEADINGS = ("code availability", "software availability", "source code availability", "code and data availability", "availability of code")
DATA_KEYWORDS = (
    "data availability", "data availability statement", "data accessibility", "data are available", "data is available", "data deposited", "dataset",
    "supplementary data", "zenodo", "dryad", "figshare", "osf", "dataverse", "upon request", "reasonable request", "repository",
)
CODE_KEYWORDS = (
    "code availability", "code is available", "code are available", "analysis code", "scripts", "software", "github", "gitlab", "bitbucket",
    "code ocean", "open source", "repository",
)
FUTURE = (
    "will be available", "will be made available", "will become available", "will be deposited", "will be archived", "available after",
    "available upon publication",
)
RESTRICTED = (
    "upon request", "available upon request", "reasonable request", "from the corresponding author", "available from the corresponding author",
    "available by request", "requests to the corresponding author",
)
EMBEDDED = (
    "in the paper", "in the article", "within the article", "in the supplementary", "in the supplement", "supplementary material",
    "supporting information only", "supplementary materials",
)
DATA_HINTS = ("zenodo.org", "figshare.com", "dryad", "dataverse", "osf.io", "openneuro", "doi.org/10.")
CODE_HINTS = ("github.com", "gitlab", "bitbucket", "huggingface.co", "codeberg.org")
#: What a mail gateway puts before and behind a link.
GATEWAY = r"(?i)https?://\s*urlde\s*fense\s*\.\s*com\s*/\s*v3\s*/\s*__\s*/?"
GATEWAY_END = r"(__\s*;?\s*!!\s*[A-Za-z0-9!$\-_\s+/=]+?)(\s+(?:and|the|on|at|in|from|or|to|is|are)\b|$)"
#: Characters that text extraction leaves behind.
INVISIBLE = "[\u200b\u200c\u200d\u00ad\ufeff]"
#: Words that end a URL of a page's layout, its most characters after the scheme, and those that it may have.
URL_ENDS = ("and", "the", "on", "at", "in", "from", "or", "to", "are", "is")
URL_CHARS = 200
URL_CLASS = r"[\p{L}\p{N}.\-_/=?&:#%]"
#: Starts of paragraphs that a page's layout clean-up drops.
DROPPED_STARTS = ("orcid", "keywords", "received", "accepted", "submitted", "correspondence", "references")
#: Where the recursive splitter cuts, coarsest first; between characters after these.
SPLIT_AT = ("\n\n", "\n", " ")
#: Pattern and license, the first that matches wins.
LICENSES = (
    (r"creative\s+commons\s+attribution\s+4\.0", "CC-BY-4.0"),
    (r"creative\s+commons\s+attribution", "CC-BY"),
    (r"cc[- ]by[- ]4\.0", "CC-BY-4.0"),
    (r"cc[- ]by", "CC-BY"),
    (r"mit\s+license", "MIT"),
    (r"gpl\s*v?3", "GPL-3.0"),
    (r"apache\s+2", "Apache-2.0"),
    (r"bsd\s+3", "BSD-3-Clause"),
    (r"bsd\s+2", "BSD-2-Clause"),
    (r"cc0", "CC0"),
)
TITLE_STOPWORDS = ("abstract", "introduction", "copyright", "doi", "license", "keywords", "data availability", "authors", "affiliations", "received", "accepted")
RESOLVER_STOPWORDS = ("abstract", "introduction", "copyright", "license", "doi", "keywords")
TITLE_CUES = ("author", "affiliation", "department", "correspondence", "university", "institute")
JOURNAL_HEADER = r"(?i)^[a-z\s]+\(\d{4}\)\s+\d+,\s+\d+-\d+$"
#: Subject, a gap without a full stop, verb.
STATEMENT_GAP = r"[-\s\w,;:/()]{0,80}"
STATEMENT_WORDS = {
    "data": (
        r"(?:code\s+and\s+raw\s+data|data(?:set|s)?|supplementary(?:\s+materials)?|raw data|materials|open data|data availability statement)",
        r"(?:available|accessible|deposited|provided|shared|request|archiv|badge)",
    ),
    "code": (
        r"(?:code|software|scripts?|analysis|notebook|pipeline|source code|code availability statement)",
        r"(?:available|accessible|provided|shared|repository|github|gitlab|bitbucket)",
    ),
}
#: One subject's and one verb's word at least is in what states availability; no white space in them.
STATEMENT_NEEDS = {
    "data": (
        ("data", "supplementary", "materials"),
        ("available", "accessible", "deposited", "provided", "shared", "request", "archiv", "badge"),
    ),
    "code": (
        ("code", "software", "script", "analysis", "notebook", "pipeline"),
        ("available", "accessible", "provided", "shared", "repository", "github", "gitlab", "bitbucket"),
    ),
}
EXPORT_COLUMNS = (
    "source_file", "filename", "title", "title_source", "doi", "doi_from_title_search", "data_availability_statement", "code_availability_statement",
    "data_sharing_license", "code_license", "data_links_count", "code_links_count", "data_links", "code_links", "error",
)


@dataclass(frozen=True)
class Settings:
    data_domains: tuple[str, ...] = DATA_DOMAINS
    code_domains: tuple[str, ...] = CODE_DOMAINS
    denied: tuple[str, ...] = DENIED
    dataset_prefixes: tuple[str, ...] = DATASET_PREFIXES
    max_contexts: int = 8
    max_file_mb: int = 50
    extensions: tuple[str, ...] = ("pdf",)
    front_chars: int = 20_000
    chunk_chars: int = 1_800
    chunk_overlap: int = 250
    cache_seconds: int = 3_600
    document_timeout_seconds: int = 900


DEFAULTS = Settings()
