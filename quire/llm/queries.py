"""The queries of this package for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, html, language, licenses, mixing, pii, quality, simhash, topk, toxicity
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    """``operator`` over whole tables."""
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Query]:
    return {
        "op1_quality": _over(quality.op1_quality, "documents", "labels"),
        "op2_language": _over(language.op2_language, "documents"),
        "op3_html_text": _over(html.op3_html_text, "pages"),
        "op4_decontaminate": _over(decontaminate.op4_decontaminate, "documents", "benchmark"),
        "op5_toxicity": _over(toxicity.op5_toxicity, "documents", "labels"),
        "op6_simhash_near_dedup": _over(simhash.op6_simhash_near_dedup, "documents"),
        "op7_license_scan": _over(licenses.op7_license_scan, "documents"),
        "op8_personal_data": _over(pii.op8_personal_data, "documents"),
        "op9_top_k": _over(topk.op9_top_k, "embeddings"),
        "op10_mix_sources": _over(mixing.op10_mix_sources, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op7_license_scan": licenses.ORACLE_SQL,
        "op8_personal_data": pii.ORACLE_SQL,
        "op9_top_k": topk.ORACLE_SQL,
        "op10_mix_sources": mixing.ORACLE_SQL,
    }
