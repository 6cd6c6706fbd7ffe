"""The text operators' queries and, where DuckDB SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sunplane.llm.chat_format import OP2_SQL, op2_chat_formatting
from sunplane.llm.decontaminate import op1_benchmark_decontamination
from sunplane.llm.html_template import op7_html_extraction
from sunplane.llm.language_id import op9_language_id
from sunplane.llm.line_dedup import OP10_SQL, op10_line_dedup
from sunplane.llm.ngram_join import op5_ngram_jaccard_join
from sunplane.llm.packing import op6_packing
from sunplane.llm.pii_lstm import op8_pii
from sunplane.llm.quality_rules import OP3_SQL, op3_quality_rules
from sunplane.llm.secret_scan import op4_secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op3_quality_rules": OP3_SQL, "op10_line_dedup": OP10_SQL}
