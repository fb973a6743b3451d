"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsmith.llm import decontam, langid, license, linedup, media, mixing, near, passages, ranked, resample, shards, suffixes, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_leaks": decontam.op1_leaks,
        "op2_media": media.op2_media,
        "op3_mix": mixing.op3_mix,
        "op4_lang": langid.op4_lang,
        "op5_lines": linedup.op5_lines,
        "op6_warc": warc.op6_warc,
        "op7_near": near.op7_near,
        "op8_license": license.op8_license,
        "op9_passages": passages.op9_passages,
        "op10_shard": shards.op10_shard,
        "op11_resample": resample.op11_resample,
        "op12_suffixes": suffixes.op12_suffixes,
        "op13_ranked": ranked.op13_ranked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_lines": linedup.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_near": near.OP7_SQL,
        "op8_license": license.OP8_SQL,
        "op11_resample": resample.OP11_SQL,
        "op12_suffixes": suffixes.OP12_SQL,
        "op13_ranked": ranked.OP13_SQL,
    }
