"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.chat import op5_chat_formatting
from kinlink.llm.decontaminate import op4_decontamination
from kinlink.llm.jaccard import op2_ngram_jaccard_join
from kinlink.llm.packing import op6_best_fit_packing
from kinlink.llm.pages import op3_html_extraction
from kinlink.llm.quality import op7_quality_classifier
from kinlink.llm.token_counts import op10_token_counts
from kinlink.llm.toxicity import op8_toxicity
from kinlink.llm.vafile import OP9_SQL, op9_exact_top_k
from kinlink.llm.warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op3_html_extraction": op3_html_extraction,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op4_decontamination": op4_decontamination,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_toxicity": op8_toxicity,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op9_exact_top_k": OP9_SQL}
