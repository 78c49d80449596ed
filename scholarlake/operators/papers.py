"""From layout blocks (doc_id, seq, page, col, text) to one record a paper.

Everything is keyed by doc_id: one shuffle brings a paper's blocks together, and windows and aggregates that follow reuse
its partitioning. Groups are papers, so none grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.config import CODE_HEADINGS, CODE_KEYWORDS, DATA_HEADINGS, DATA_KEYWORDS, DEFAULTS, JOURNAL_HEADER, RESOLVER_STOPWORDS, TITLE_CUES, Settings
from scholarlake.functions import doi as D
from scholarlake.functions import records as R
from scholarlake.functions import text as T
from scholarlake.functions import urls as U
from scholarlake.operators import answers as A
from scholarlake.sources.states import scratch


def _in_order(*columns: str):
    return Window.partitionBy("doc_id").orderBy(*columns)


def heading_label(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 100))  # longer than any heading
    starts = lambda words: low.rlike("^(?:" + "|".join(words) + ")")
    letters = ~text.rlike("[a-z]") & (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(starts(DATA_HEADINGS), "data").when(starts(CODE_HEADINGS), "code").when(letters & (T.word_count(text) <= 6), "generic")


def segment(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, label, text: paragraphs; a labelled one with a colon that is not a URL's is cut into heading and rest."""
    # *_outer: from the others Spark infers a filter on what is exploded, which is then worked out twice
    raw = blocks.select("doc_id", "seq", F.posexplode_outer(F.split("text", "\n{2,}")).alias("part", "block")).withColumn("block", F.trim("block")).where("block <> ''")
    raw = raw.withColumn("text", T.collapse("block")).withColumn("label", heading_label(F.col("text")))  # columns of their own: worked out once
    text, label = F.col("text"), F.col("label")
    at = F.instr(F.col("block"), ":")
    colon = (at > 1) & (at <= 80) & ~F.substr(F.col("block"), at, F.lit(3)).eqNullSafe("://") & (F.instr(F.substring_index("block", "\n", 1), ":") > 0)
    head = F.concat(T.collapse(F.substr(F.col("block"), F.lit(1), at - 1)), F.lit(":"))
    rest = T.collapse(F.substr(F.col("block"), at + 1))
    none = F.lit(None).cast("string")
    piece = lambda name, t: F.struct(name.alias("label"), t.alias("text"))
    cut = F.filter(F.array(piece(label, head), piece(none, rest)), lambda p: p["text"] != "")
    pieces = F.when(label.isin("data", "code") & colon, cut).otherwise(F.array(piece(label, text)))
    rows = raw.select("doc_id", "seq", "part", F.posexplode_outer(pieces).alias("piece", "p")).where("p IS NOT NULL").select("doc_id", "seq", "part", "piece", "p.label", "p.text")
    return rows.withColumn("idx", F.row_number().over(_in_order("seq", "part", "piece")) - 1).select("doc_id", "idx", "label", "text")


#: Parts of words; a text without a part is not searched for the words that hold it.
_STEMS = ("data", "code", "request", "git", ".com")


def _by_stem(low: Column, words, hit) -> list[Column]:
    """hit(words) for those that share a stem, looked at only where the stem is, else 0; and for each other word."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(next((s for s in _STEMS if s in word), word), []).append(word)
    return [F.when(low.contains(stem), hit(held)).otherwise(0) if len(held) > 1 else hit(held) for stem, held in groups.items()]


def shared_points(denied) -> Column:
    """What counts for either kind in the score of a paragraph (text, and low: its text in lower case), in tenths."""
    low = F.col("low")
    asked = _by_stem(low, ("upon request", "reasonable request"), lambda words: F.when(T.any_of(low, words), 5).otherwise(0))
    bad = F.lit(False)
    for part in _by_stem(low, denied, lambda words: F.when(T.any_of(low, words), 1).otherwise(0)):
        bad = bad | (part > 0)
    return (
        sum(asked, F.lit(0))
        + F.when(T.any_of(low, ("supplementary", "supporting information")), 4).otherwise(0)
        - F.when(bad, 15).otherwise(0)
        - F.when(F.col("text").endswith(":") & (F.length("text") < 80), 30).otherwise(0)
    )


def context_points(kind: str, near: Column) -> Column:
    """Score of a paragraph (label, low, and shared: shared_points()) in tenths: whole numbers, so that ties and the cut are exact."""
    low = F.col("low")
    points = F.when(F.col("label") == kind, 50).when(F.col("label") == "generic", 10).otherwise(0) + F.when(near, 22).otherwise(0)
    each = lambda words: sum((F.when(low.contains(w), 14).otherwise(0) for w in words), F.lit(0))
    words = sum(_by_stem(low, DATA_KEYWORDS if kind == "data" else CODE_KEYWORDS, each), F.lit(0))
    return points + words + F.when(low.contains("available") & low.contains(kind), 12).otherwise(0) + F.col("shared")


def grouped_contexts(paragraphs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, kind, contexts: for data and for code the best paragraphs (array of points, source, idx, text, the best first);
    without any, all text as one. Windows and the group share the shuffle by doc_id."""
    order = _in_order("idx")
    paragraphs = paragraphs.withColumn("low", F.lower("text")).withColumn("shared", shared_points(settings.denied))
    kinds = []
    for kind in ("data", "code"):
        head = F.coalesce(F.col("label") == kind, F.lit(False))
        near = F.lag(head, 1, False).over(order) | F.lag(head, 2, False).over(order)
        paragraphs = paragraphs.withColumn(f"near_{kind}", near)
        paragraphs = paragraphs.withColumn(f"points_{kind}", context_points(kind, F.col(f"near_{kind}")))
        kinds.append(F.struct(F.lit(kind).alias("kind"), F.col(f"points_{kind}").alias("points"), F.when(head, "heading").otherwise("phrase").alias("source")))
    rows = paragraphs.select("doc_id", "idx", "text", F.explode(F.array(*kinds)).alias("k"))
    fields = (-F.col("k.points")).alias("minus"), F.col("idx").cast("int").alias("idx"), "text", "k.source"
    all_ranked = rows.groupBy("doc_id", "k.kind").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p"))
    best = F.transform(F.filter("p", lambda x: x["minus"] < -5), lambda x: F.struct((-x["minus"]).alias("points"), x["source"].alias("source"), x["idx"].alias("idx"), x["text"].alias("text")))
    in_order = F.array_sort("p", lambda x, y: x["idx"] - y["idx"])
    whole = T.collapse(F.array_join(F.transform(in_order, lambda x: x["text"]), " "))
    one = F.array(F.struct(F.lit(10).alias("points"), F.lit("global").alias("source"), F.lit(0).alias("idx"), whole.alias("text")))
    return all_ranked.select("doc_id", "kind", F.when(F.size(best) > 0, F.slice(best, 1, settings.max_contexts)).otherwise(one).alias("contexts"))


def rank_contexts(paragraphs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, kind, rank, points, source, idx, text: a row for each of grouped_contexts()."""
    rows = grouped_contexts(paragraphs, settings).select("doc_id", "kind", F.posexplode_outer("contexts").alias("at", "c")).where("c IS NOT NULL")
    return rows.select("doc_id", "kind", (F.col("at") + 1).alias("rank"), "c.points", "c.source", "c.idx", "c.text")


def _trimmed(text: Column, kind: str) -> Column:
    """The first sentence, else the first pair of neighbours, that states availability; not looked for in texts that can't have one."""
    ok = lambda x: R.states_availability(x, kind)

    def first(s: Column) -> Column:
        left, right = F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
        pairs = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.coalesce(F.get(F.filter(s, ok), F.lit(0)), F.get(F.filter(pairs, ok), F.lit(0)))

    return F.when(T.let(F.lower(text), lambda low: R.may_state(low, kind)), T.let(T.statement_sentences(text), first))


def _by_kind(fn) -> Column:
    return F.when(F.col("kind") == "data", fn("data")).otherwise(fn("code"))


def statements(grouped: DataFrame) -> DataFrame:
    """grouped_contexts() with cleaned contexts (their URLs in canonical form), statement and confidence: the first
    trimmed statement of a context, in rank order, else the best context if it states availability as a whole, else null."""
    clean = F.transform("contexts", lambda c: F.struct(c["points"].alias("points"), c["source"].alias("source"), c["idx"].alias("idx"), U.canonical(c["text"]).alias("text")))
    grouped = grouped.withColumn("contexts", clean)
    sure = _by_kind(lambda k: F.get(F.filter(F.transform("contexts", lambda c: F.struct(_trimmed(c["text"], k).alias("text"), c["points"].alias("points"))), lambda x: x["text"].isNotNull()), F.lit(0)))
    first = F.get("contexts", F.lit(0))
    whole = F.struct(U.canonical(T.repair_spacing(first["text"])).alias("text"), first["points"].alias("points"))
    stated = T.let(whole, lambda w: F.when(_by_kind(lambda k: R.states_availability(w["text"], k)), w))
    joins = lambda low: T.any_of(low, ("-", "__", "http"))  # noqa: E731  repairs may make words of parts
    may = T.let(F.lower(first["text"]), lambda low: joins(low) | _by_kind(lambda k: R.may_state(low, k)))
    rows = grouped.withColumn("sure", sure).withColumn("weak", F.when(F.col("sure").isNull() & may, stated))  # only where no sentence says it
    confidence = F.when(F.col("sure").isNotNull(), F.least(F.lit(0.6), F.col("sure.points") / 80)).when(F.col("weak").isNotNull(), F.least(F.lit(0.4), F.col("weak.points") / 100))
    return rows.withColumns({"statement": F.coalesce("sure.text", "weak.text"), "confidence": F.round(confidence, 6)}).drop("sure", "weak")


def with_links(stated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """statements() with links: the accepted links of the statement in order, each once; none without a statement."""
    found = _by_kind(lambda k: U.links(U.canonical("statement"), k, settings))
    return stated.withColumn("links", F.coalesce(found, F.array().cast("array<string>")))


def paper_links(grouped: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, kind, pos, url."""
    return with_links(statements(grouped), settings).select("doc_id", "kind", F.posexplode_outer("links").alias("pos", "url")).where("url IS NOT NULL")


def with_answers(found: DataFrame, replies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """with_links() where a language model's reply (doc_id, reply) that is grounded in the contexts takes the place of the fallback.

    Without a reply, or with one that is not JSON, absent, not quoted from a context or not about availability, the fallback stays."""
    rows = found.join(replies.select("doc_id", A.parse_answer("reply").alias("answer")), "doc_id", "left")
    texts = F.transform("contexts", lambda c: c["text"])
    rows = rows.withColumn("said", _by_kind(lambda k: A.grounded_with_links(F.col("answer"), texts, k, settings)))
    pick = lambda c: F.when(F.col("said").isNotNull(), F.col(f"said.{c}")).otherwise(F.col(c))
    return rows.withColumns({"statement": pick("statement"), "links": pick("links"), "confidence": pick("confidence"), "fallback": F.col("said").isNull()}).drop("said", "answer")


def availability(blocks: DataFrame, settings: Settings = DEFAULTS, replies: DataFrame | None = None) -> DataFrame:
    """doc_id, kind, statement, confidence, links (array), status; from the contexts, or from replies (doc_id, reply) where they hold."""
    rows = with_links(statements(grouped_contexts(segment(blocks), settings)), settings)
    if replies is not None:
        rows = with_answers(rows, replies, settings)
    status = _by_kind(lambda k: R.availability_status("statement", F.size("links"), k))
    return rows.select("doc_id", "kind", "statement", "confidence", "links", status.alias("status"))


# --- DOIs


def whole_text(blocks: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "col", "seq", "text"))), lambda b: b["text"]), "\n")
    return blocks.groupBy("doc_id").agg(joined.alias("text"))


def doi_candidates(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, ordinal, doi, score: article DOI candidates of the front matter; without any there, of the whole text."""
    parts = F.array(D.front_matter("text", settings.front_chars), F.col("text"))
    found = F.filter(F.transform(parts, lambda x: D.candidates(x, settings.dataset_prefixes)), lambda c: F.size(c) > 0)
    rows = whole_text(blocks).select("doc_id", "text", F.posexplode(F.get(found, F.lit(0))).alias("ordinal", "doi"))
    return rows.select("doc_id", "ordinal", "doi", D.score("text", "doi").alias("score"))


def complete_dois(best: DataFrame, blocks: DataFrame, replies: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """best_doi() with papers that it has none for: a model's DOI (replies: doc_id, doi_reply) if it stands in the text (0.5),
    else the first DOI of the text that is no dataset's (0.45)."""
    rows = whole_text(blocks).withColumn("swept", D.first_doi("text"))  # a column of its own: expressions that use it stay small
    rows = rows.withColumn("swept", F.when(~D.is_dataset("swept", settings.dataset_prefixes), F.col("swept"))).join(best, "doc_id", "left")
    if replies is not None:
        rows = rows.join(replies.select("doc_id", D.validate_doi("doi_reply").alias("said")), "doc_id", "left").withColumn("said", F.when(F.contains("text", "said"), F.col("said")))
    else:
        rows = rows.withColumn("said", F.lit(None).cast("string"))
    sure = F.when(F.col("doi").isNotNull(), F.col("confidence")).when(F.col("said").isNotNull(), 0.5).when(F.col("swept").isNotNull(), 0.45)
    return rows.select("doc_id", F.coalesce("doi", "said", "swept").alias("doi"), sure.alias("confidence")).where("doi IS NOT NULL")


def best_doi(candidates: DataFrame) -> DataFrame:
    """doc_id, doi, confidence: the highest score, the earliest among equals."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal"))
    return candidates.withColumn("n", first).where("n = 1").select("doc_id", "doi", F.least(F.lit(1.0), "score").alias("confidence"))


# --- titles


def heuristic_title(blocks: DataFrame) -> DataFrame:
    """doc_id, title: the first block of page 1, column 0 that looks like a title."""
    rows = blocks.where("page = 1 AND col = 0").withColumn("title", T.collapse("text"))
    return rows.where(R.is_title("title")).groupBy("doc_id").agg(F.min_by("title", "seq").alias("title"))


def bad_title(x: Column) -> Column:
    words = T.word_count(x)
    stop = r"(?i)\b(?:" + "|".join(RESOLVER_STOPWORDS) + r")\b"
    return ~(F.length(x).between(8, 280) & words.between(2, 50) & ~x.rlike(stop) & ~x.rlike(JOURNAL_HEADER) & (T.alpha_ratio(x) >= 0.4))


def title_lines(blocks: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, lines: the first lines of page 1, column 0 up to an affiliation; journal headers are left out."""
    cue = r"(?i)\b(?:" + "|".join(TITLE_CUES) + r")\b"
    first = F.sort_array(F.collect_list(F.struct("seq", F.trim("text").alias("text"))))
    grouped = blocks.where("page = 1 AND col = 0").groupBy("doc_id").agg(first.alias("blocks"))

    def fold(held: Column, block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block["text"], "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(JOURNAL_HEADER))
        cut = F.array_position(F.transform(lines, lambda s: s.rlike(cue)), True)
        taken = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
        stop = held["done"] | ((F.size(held["lines"]) > 0) & block["text"].rlike(cue)) | (F.size(held["lines"]) >= most)
        skip = (block["text"] == "") | block["text"].rlike(JOURNAL_HEADER)
        grown = F.slice(F.concat(held["lines"], taken), 1, most)
        return F.struct(F.when(stop | skip, held["lines"]).otherwise(grown).alias("lines"), stop.alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("done"))
    return grouped.select("doc_id", F.aggregate("blocks", start, fold)["lines"].alias("lines"))


def resolved_title(blocks: DataFrame) -> DataFrame:
    """doc_id, title, confidence: one of the first four lines, else up to four joined by a colon, else by spaces, else the longest line."""
    lines = F.transform("lines", T.collapse)
    four = F.slice(lines, 1, 4)
    ok = lambda x: ~bad_title(x)
    grown = lambda by: F.transform(F.sequence(F.lit(1), F.greatest(F.size(four), F.lit(1))), lambda i: F.array_join(F.slice(four, F.lit(1), i), by))
    first = lambda xs: F.get(F.filter(xs, ok), F.lit(0))
    longest = F.get(F.filter(lines, lambda x: F.length(x) == F.array_max(F.transform(lines, F.length))), F.lit(0))
    options = ((first(four), 0.6), (first(grown(": ")), 0.56), (first(grown(" ")), 0.54), (F.when(ok(longest), longest), 0.5))
    sure = F.lit(0.0)
    for title, c in reversed(options):
        sure = F.when(title.isNotNull(), c).otherwise(sure)
    return title_lines(blocks).select("doc_id", F.coalesce(*(t for t, _ in options)).alias("title"), sure.alias("confidence"))


def record_titles(blocks: DataFrame, replies: DataFrame | None = None, prefer_model: bool = False) -> DataFrame:
    """doc_id, title, title_source, title_confidence: the resolver's title, else the first block that looks like one (both
    `heuristic`), else a model's of 10 to 300 characters (replies: doc_id, title_reply; `llm`), which prefer_model puts first.
    Papers without any have nulls; a confidence comes with the resolver's titles alone."""
    rows = resolved_title(blocks).withColumnsRenamed({"title": "resolved", "confidence": "sure"})
    rows = rows.join(heuristic_title(blocks).withColumnRenamed("title", "looked"), "doc_id", "left")
    if replies is not None and "title_reply" in replies.columns:
        said = F.trim(T.none_to_null("title_reply"))
        rows = rows.join(replies.select("doc_id", F.when(F.length(said).between(10, 300), said).alias("said")), "doc_id", "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("string"))
    own = F.coalesce("resolved", "looked")
    title = F.coalesce(F.col("said"), own) if prefer_model else F.coalesce(own, F.col("said"))
    by_model = F.col("said").isNotNull() & (F.lit(True) if prefer_model else own.isNull())
    source = F.when(by_model, "llm").when(own.isNotNull(), "heuristic")
    return rows.select("doc_id", title.alias("title"), source.alias("title_source"), F.when(~by_model, F.col("sure")).alias("title_confidence"))


# --- registry


def _needed(n: Column, m: Column, least: float) -> Column:
    """How many tokens sets of n and m must share for their Jaccard similarity to be at least `least`."""
    return F.ceil(F.lit(least / (1 + least)) * (n + m) - 1e-9).cast("int")


def set_keys(sets: DataFrame, partner_sizes: DataFrame, least: float) -> DataFrame:
    """Keys of sets (id, common: tokens in the order of all sets, size): own, other, a, b and id, rest.

    For each size of a partner that can be similar enough, sets that share enough tokens share two among the first few of
    them (one, if one is enough); each pair of these is a key (a, b) for the two sizes. rest: how many tokens come after b, so
    that a pair of sets can be left out whose later tokens can't be enough.
    """
    n, m, k = F.col("size"), F.col("other"), F.size("common")
    sized = sets.join(F.broadcast(partner_sizes.select(F.col("size").alias("other"))), (F.col("other") >= F.ceil(F.lit(least) * F.col("size") - 1e-9)) & (F.col("other") * least <= F.col("size") + 1e-9))
    rows = sized.withColumn("need", _needed(n, m, least)).withColumn("first", F.slice("common", F.lit(1), F.greatest(F.lit(0), k - F.col("need") + F.least(F.col("need"), F.lit(2)))))
    item = lambda a, b, at: F.struct(a.alias("a"), b.alias("b"), (F.size("common") - at - 1).cast("int").alias("rest"))
    single = F.transform("first", lambda t, i: item(t, F.lit(""), i))
    after = lambda i: F.slice("first", i + 2, F.size("first"))
    double = F.flatten(F.transform("first", lambda t, i: F.transform(after(i), lambda u, j: item(t, u, i + 1 + j))))
    keyed = rows.select("id", F.col("size").alias("own"), "other", F.explode(F.when(F.col("need") < 2, single).otherwise(double)).alias("key"))
    return keyed.select("id", "own", "other", "key.*")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_id, r_id, similarity of the sets (id, common, size) whose shared tokens of `common` make them similar enough: by keys of
    two tokens for each pair of sizes, so that neither frequent tokens nor sizes far apart bring sets together."""
    ours = set_keys(left, right.select("size").distinct(), least).select(*(F.col(c).alias(f"l_{c}") for c in ("id", "own", "other", "a", "b", "rest")))
    theirs = set_keys(right, left.select("size").distinct(), least).select(*(F.col(c).alias(f"r_{c}") for c in ("id", "own", "other", "a", "b", "rest")))
    same = (F.col("l_own") == F.col("r_other")) & (F.col("l_other") == F.col("r_own")) & (F.col("l_a") == F.col("r_a")) & (F.col("l_b") == F.col("r_b"))
    held = F.when(F.col("l_b") == "", 1).otherwise(2) + F.least("l_rest", "r_rest")
    pairs = ours.join(theirs, same & (held >= _needed(F.col("l_own"), F.col("r_own"), least))).select("l_id", "r_id").distinct()
    pairs = pairs.join(left.select(F.col("id").alias("l_id"), F.col("common").alias("l"), F.col("size").alias("n")), "l_id")
    pairs = pairs.join(right.select(F.col("id").alias("r_id"), F.col("common").alias("r"), F.col("size").alias("m")), "r_id")
    both = F.size(F.array_intersect("l", "r"))
    return pairs.select("l_id", "r_id", (both / (F.col("n") + F.col("m") - both)).alias("similarity")).where(F.col("similarity") >= least)


def best_registry_match(titles: DataFrame, registry: DataFrame, preferred: str = "crossref", least: float = 0.4, rare: int = 50) -> DataFrame:
    """doc_id, doi, similarity, source: the registry's most similar title by tokens, if its similarity is at least `least`.

    Exact in two ways that meet. Entries that share a token which at most `rare` registry titles hold are compared one by one. For all others only
    an entry's frequent tokens and the number of its tokens count, so entries and titles that agree in these are one
    profile, represented by its preferred entry; profiles are joined by similar_sets(), whose keys are pairs of their rarest
    tokens. An entry of a profile that shares a rare token as well is found better by the first way.
    """
    entries = registry.select(D.doi_key("doi").alias("doi"), "source", T.tokens("title").alias("tokens")).distinct()
    counts = entries.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    mine = titles.select("doc_id", T.tokens("title").alias("tokens"))
    rank = lambda doi, source: (F.coalesce(source != preferred, F.lit(True)).alias("other"), doi.alias("doi"), source.alias("source"))

    some = entries.select("doi", "source", F.col("tokens").alias("r"), F.explode("tokens").alias("token")).join(counts.where(F.col("held") <= rare).select("token"), "token")
    shared = mine.select("doc_id", F.col("tokens").alias("t"), F.explode("tokens").alias("token")).join(some, "token")
    near = shared.select("doc_id", T.jaccard(F.col("t"), F.col("r")).alias("similarity"), *rank(F.col("doi"), F.col("source"))).where(F.col("similarity") >= least)

    common = counts.where(F.col("held") > rare)

    def profiled(rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows with common (frequent tokens, rarest first), size (all tokens) and their digest as id."""
        held = rows.select(*keys, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(common, "token")
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("held", "token"))), lambda x: x["token"])
        return held.groupBy(*keys, "size").agg(in_order.alias("common")).withColumn("id", F.unhex(F.md5(F.concat_ws(" ", F.col("size").cast("string"), "common").cast("binary"))))

    sets = profiled(mine, ["doc_id"])
    theirs = profiled(entries.select("doi", "source", "tokens"), ["doi", "source"]).groupBy("id", "common", "size").agg(F.min(F.struct(*rank(F.col("doi"), F.col("source")))).alias("best"))
    pairs = similar_sets(sets.select("id", "common", "size").distinct(), theirs, least).join(theirs.select(F.col("id").alias("r_id"), "best"), "r_id")
    far = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "best")).alias("m"))
    far = sets.join(far, "id").select("doc_id", (-F.col("m.minus")).alias("similarity"), "m.best.other", "m.best.doi", "m.best.source")

    best = near.unionByName(far).groupBy("doc_id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "other", "doi", "source")).alias("m"))
    return best.select("doc_id", "m.doi", (-F.col("m.minus")).alias("similarity"), "m.source")


def verify_doi(best: DataFrame, titles: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, doi, confidence, doi_from_title_search for every titled paper."""
    record = registry.select(D.doi_key("doi").alias("key"), F.col("title").alias("record_title"))
    rows = titles.join(best, "doc_id", "left").withColumn("key", D.doi_key("doi")).join(record, "key", "left")
    found = best_registry_match(titles, registry).select("doc_id", F.col("doi").alias("found"), "similarity")
    own = F.when(F.col("record_title").isNotNull(), D.title_similarity("title", "record_title"))
    r = D.reconcile(F.col("doi"), F.col("confidence"), own, F.col("found"), F.col("similarity"))
    return rows.join(found, "doc_id", "left").select("doc_id", r.alias("r")).select("doc_id", "r.doi", F.round("r.confidence", 6).alias("confidence"), F.col("r.replaced").alias("doi_from_title_search"))


# --- records


def _written(rows: DataFrame, what: str) -> DataFrame:
    """rows, worked out once and read back: for small rows that several joins need."""
    path = scratch(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def paper_records(blocks: DataFrame, registry: DataFrame, settings: Settings = DEFAULTS, replies: DataFrame | None = None, prefer_model: bool = False) -> DataFrame:
    """One row a paper: title, DOI, statements, status, links, licenses, confidences, warnings.

    replies: doc_id and a language model's reply, doi_reply, data_license and code_license, each of which may be null, and
    title_reply if it is there; prefer_model: see record_titles()."""
    titles = _written(record_titles(blocks, replies, prefer_model), "titles")  # the match reads them more than once
    dois = verify_doi(complete_dois(best_doi(doi_candidates(blocks, settings)), blocks, replies, settings), titles.select("doc_id", "title"), registry).withColumnRenamed("confidence", "doi_confidence")
    kinds = availability(blocks, settings, replies).groupBy("doc_id").agg(
        *(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("data", "code") for c in ("statement", "status", "confidence", "links"))
    )
    for k in ("data", "code"):
        kinds = kinds.withColumn(f"{k}_license", F.lit(None).cast("string"))
    if replies is not None:
        answer = lambda k: R.normalize_license(R.license_answer(T.none_to_null(f"{k}_license"))).alias(f"{k}_license")
        kinds = kinds.drop("data_license", "code_license").join(replies.select("doc_id", answer("data"), answer("code")), "doc_id", "left")
    scores = F.create_map(*(x for c in ("title", "doi", "data", "code") for x in (F.lit(c), F.col(f"{c}_confidence"))))
    return titles.join(dois, "doc_id").join(kinds, "doc_id", "left").select(
        "doc_id",
        "title",
        "title_source",
        "doi",
        "doi_from_title_search",
        *(f"{k}_{c}" for k in ("data", "code") for c in ("statement", "status")),
        F.coalesce("data_links", F.array().cast("array<string>")).alias("data_links"),
        F.coalesce("code_links", F.array().cast("array<string>")).alias("code_links"),
        "data_license",
        "code_license",
        F.map_filter(scores, lambda k, v: v.isNotNull()).alias("confidences"),
        R.quality_warnings("data_statement", "code_statement", F.coalesce(F.size("data_links"), F.lit(0)), F.coalesce(F.size("code_links"), F.lit(0)), "data_license", "code_license").alias("warnings"),
    )
