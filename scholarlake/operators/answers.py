"""Language-model answers about availability: prompts, parsing, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.config import DEFAULTS, Settings
from scholarlake.functions import records as R
from scholarlake.functions import text as T
from scholarlake.functions import urls as U
from scholarlake.functions.text import col, none_to_null

ANSWER = "data struct<verdict:string,raw_quote:string,clean_statement:string,links:array<string>,confidence:variant>, code struct<verdict:string,raw_quote:string,clean_statement:string,links:array<string>,confidence:variant>"
RULES = (
    "Answer with one JSON object that has the keys data and code.",
    "Each holds verdict (present or absent), raw_quote, clean_statement, links and confidence.",
    "Quote only what the numbered contexts say; use none where they say nothing.",
)


def build_prompt(contexts: DataFrame) -> DataFrame:
    """doc_id, prompt: rules, then each kind's contexts numbered by rank."""
    line = F.concat_ws("", F.lit("["), "kind", F.lit(" "), F.col("rank").cast("string"), F.lit("] "), "text")
    listed = F.sort_array(F.collect_list(F.struct("kind", "rank", line.alias("line"))))
    return contexts.groupBy("doc_id").agg(F.concat_ws("\n", F.lit("\n".join(RULES)), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("prompt"))


def build_messages(contexts: DataFrame) -> DataFrame:
    """doc_id, system, prompt: the rules as the system text, each kind's contexts numbered by rank as the prompt."""
    head = len("\n".join(RULES)) + 1
    return build_prompt(contexts).select("doc_id", F.lit("\n".join(RULES)).alias("system"), F.substr("prompt", F.lit(head + 1)).alias("prompt"))


def parse_answer(reply: Column | str) -> Column:
    """The reply's JSON object, else that between its outermost braces; null without one."""
    reply = col(reply)
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.from_json(inner, ANSWER))


def _number(x: Column) -> Column:
    """A JSON number or truth value as a double; null for anything else."""
    return F.when(F.schema_of_variant(x).isin("STRING", "VOID") | F.schema_of_variant(x).rlike("^(ARRAY|OBJECT)"), F.lit(None)).otherwise(F.try_variant_get(x, "$", "double"))


def grounded(answer: Column, contexts: Column, kind: str) -> Column:
    """struct<statement, confidence> of grounded_with_links()."""
    found = grounded_with_links(answer, contexts, kind)
    return F.when(found.isNotNull(), F.struct(found["statement"].alias("statement"), found["confidence"].alias("confidence")))


def grounded_with_links(answer: Column, contexts: Column, kind: str, settings: Settings = DEFAULTS) -> Column:
    """struct<statement, links, confidence> of one kind, if its verdict is present and its quote stands in a context and states availability.

    Links are those of the answer that are accepted, fused ones cut; without any, those of the quote."""
    part = answer[kind]
    quote = U.canonical(T.repair_spacing(F.trim(none_to_null(part["raw_quote"]))))
    there = F.exists(contexts, lambda c: T.collapse(U.canonical(c)).contains(T.collapse(U.canonical(quote))))
    ok = (F.lower(part["verdict"]) == "present") & there & R.states_availability(quote, kind)
    statement = U.canonical(T.repair_spacing(F.trim(F.coalesce(none_to_null(part["clean_statement"]), quote))))
    given = F.flatten(F.transform(F.coalesce(part["links"], F.array().cast("array<string>")), lambda u: F.split(u, "(?=https?://)")))
    said = U.accepted(given, kind, settings)
    links = F.when(F.size(said) > 0, said).otherwise(U.links(U.canonical(quote), kind, settings))
    return F.when(ok, F.struct(statement.alias("statement"), links.alias("links"), R.confidence(_number(part["confidence"])).alias("confidence")))
