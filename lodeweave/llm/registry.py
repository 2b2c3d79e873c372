"""The queries of this subpackage, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import bpe, chat_format, collocations, decontaminate, license_scan, line_templates, near_duplicates, page_text, private_terms, quality_rules, ranked_search, similarity_join, token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": page_text.query,
    "op2_line_templates": line_templates.query,
    "op3_decontaminate": decontaminate.query,
    "op4_bpe": bpe.query,
    "op5_private_terms": private_terms.query,
    "op6_token_records": token_records.query,
    "op7_near_duplicates": near_duplicates.query,
    "op8_chat_format": chat_format.query,
    "op9_license_scan": license_scan.query,
    "op10_quality_rules": quality_rules.query,
    "op11_similarity_join": similarity_join.query,
    "op12_ranked_search": ranked_search.query,
    "op13_collocations": collocations.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_templates": line_templates.oracle_sql(),
    "op3_decontaminate": decontaminate.oracle_sql(),
    "op8_chat_format": chat_format.oracle_sql(),
    "op9_license_scan": license_scan.oracle_sql(),
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_similarity_join": similarity_join.oracle_sql(),
    "op12_ranked_search": ranked_search.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
