"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, fim, htmltext, langid, mixing, pii, simhash, suffix, tokens, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_simhash": simhash.op2_simhash,
        "op3_suffix": suffix.op3_suffix,
        "op4_tokens": tokens.op4_tokens,
        "op5_topk": topk.op5_topk,
        "op6_warc": warc.op6_warc,
        "op7_mixing": mixing.op7_mixing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_decontam": decontam.op9_decontam,
        "op10_langid": langid.op10_langid,
        "op11_fim": fim.op11_fim,
        "op12_audit": audit.op12_audit,
        "op13_html": htmltext.op13_html,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_topk": topk.ORACLE,
        "op6_warc": warc.ORACLE,
        "op11_fim": fim.ORACLE,
        "op12_audit": audit.ORACLE,
    }
