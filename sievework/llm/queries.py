"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from sievework.llm import (
    chunk_dedup, decontaminate, html_extract, importance, langid, license_scan, line_quality, mixing, simhash, spotsigs, suffix_dedup, url_filter, yinyang,
)


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_decontaminate": decontaminate.query,
        "op2_chunk_dedup": chunk_dedup.query,
        "op3_license_scan": license_scan.query,
        "op4_html_extract": html_extract.query,
        "op5_mix_sources": mixing.query,
        "op6_simhash": simhash.query,
        "op7_language_id": langid.query,
        "op8_suffix_dedup": suffix_dedup.query,
        "op9_spotsigs": spotsigs.query,
        "op10_url_filter": url_filter.query,
        "op11_line_quality": line_quality.query,
        "op12_importance": importance.query,
        "op13_yinyang": yinyang.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op10_url_filter": url_filter.SQL,
        "op11_line_quality": line_quality.SQL,
        "op12_importance": importance.SQL,
        "op13_yinyang": yinyang.SQL,
    }
