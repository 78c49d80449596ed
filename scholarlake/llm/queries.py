"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarlake.llm.bpe import op8_byte_bpe
from scholarlake.llm.chat_format import OP7_SQL, op7_chat_format
from scholarlake.llm.collocations import OP12_SQL, op12_collocations
from scholarlake.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from scholarlake.llm.decontaminate import op2_decontaminate
from scholarlake.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from scholarlake.llm.hmm import op5_hmm_score
from scholarlake.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from scholarlake.llm.nearest import op11_nearest
from scholarlake.llm.quality import op10_quality
from scholarlake.llm.suffix_dedup import op1_suffix_dedup
from scholarlake.llm.token_file import op3_token_ids
from scholarlake.llm.url_filter import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_ids": op3_token_ids,
    "op4_url_filter": op4_url_filter,
    "op5_hmm_score": op5_hmm_score,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_format": op7_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_nearest": op11_nearest,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op6_jaccard_join": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_collocations": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
