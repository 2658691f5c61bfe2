"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lrforge.llm.filters import OP12_SQL, op12_filter_audit
from lrforge.llm.langid import op2_language_id
from lrforge.llm.linededup import OP4_SQL, op4_line_dedup
from lrforge.llm.mixing import OP1_SQL, op1_mix_sources
from lrforge.llm.neardup import OP8_SQL, op8_near_duplicates
from lrforge.llm.ngrams import OP11_SQL, op11_lm_scores
from lrforge.llm.pieces import op5_sentencepiece
from lrforge.llm.quality import ABLATIONS_SQL, OP10_SQL, op10_quality_rules, quality_ablations
from lrforge.llm.topk import OP7_SQL, op7_top_k
from lrforge.llm.toxicity import op3_toxicity
from lrforge.llm.trie import OP13_SQL, op13_conversation_trie
from lrforge.llm.urls import ALIASES_SQL, OP9_SQL, op9_url_filters, url_alias_verdicts
from lrforge.llm.warc import OP6_SQL, op6_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_language_id": op2_language_id,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_warc": op6_warc,
        "op7_top_k": op7_top_k,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_url_filters": op9_url_filters,
        "op10_quality_rules": op10_quality_rules,
        "op11_lm_scores": op11_lm_scores,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_trie": op13_conversation_trie,
        "url_alias_verdicts": url_alias_verdicts,
        "quality_ablations": quality_ablations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL,
        "op4_line_dedup": OP4_SQL,
        "op6_warc": OP6_SQL,
        "op7_top_k": OP7_SQL,
        "op8_near_duplicates": OP8_SQL,
        "op9_url_filters": OP9_SQL,
        "op10_quality_rules": OP10_SQL,
        "op11_lm_scores": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_conversation_trie": OP13_SQL,
        "url_alias_verdicts": ALIASES_SQL,
        "quality_ablations": ABLATIONS_SQL,
    }
