"""Registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from kasaflow.llm.decontam import op3_decontamination
from kasaflow.llm.html_text import op5_html_text
from kasaflow.llm.langid import op8_language
from kasaflow.llm.lexical import op13_lexical
from kasaflow.llm.line_dedup import op12_line_dedup
from kasaflow.llm.mixing import op4_mixing
from kasaflow.llm.ngram_join import op9_ngram_join
from kasaflow.llm.quality import op10_quality
from kasaflow.llm.sharding import op1_sharding
from kasaflow.llm.spelling import op11_spelling
from kasaflow.llm.sql import LEXICAL, LINE_DEDUP, MIXING, NGRAM_JOIN, SPELLING, TOP_K
from kasaflow.llm.token_counts import op6_token_counts
from kasaflow.llm.topk import op7_topk
from kasaflow.llm.toxicity import op2_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_mixing": op4_mixing,
        "op5_html_text": op5_html_text,
        "op6_token_counts": op6_token_counts,
        "op7_topk": op7_topk,
        "op8_language": op8_language,
        "op9_ngram_join": op9_ngram_join,
        "op10_quality": op10_quality,
        "op11_spelling": op11_spelling,
        "op12_line_dedup": op12_line_dedup,
        "op13_lexical": op13_lexical,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators rest on trained models, a vocabulary file, hashed sampling or a
    tree of markup, which SQL cannot express; tests/llm holds them against brute force."""
    found = {"op4_mixing": MIXING, "op7_topk": TOP_K, "op9_ngram_join": NGRAM_JOIN, "op11_spelling": SPELLING,
             "op12_line_dedup": LINE_DEDUP, "op13_lexical": LEXICAL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
