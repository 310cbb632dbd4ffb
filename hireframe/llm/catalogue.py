"""Registry of the queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, centroids, decontaminate, html_text, lexical_search, license_scan, near_dup, packing, repetition, sharding, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_quality_rules": repetition.op2_quality_rules,
        "op3_near_duplicates": near_dup.op3_near_duplicates,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_sharding": sharding.op5_sharding,
        "op6_packing": packing.op6_packing,
        "op7_main_text": html_text.op7_main_text,
        "op8_bpe_roundtrip": bpe.op8_bpe_roundtrip,
        "op9_topk": topk.op9_topk,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_centroid_clusters": centroids.op11_centroid_clusters,
        "op12_ranked_search": lexical_search.op12_ranked_search,
        "op13_decontaminate": decontaminate.op13_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op9_topk": topk.ORACLE,
        "op11_centroid_clusters": centroids.ORACLE,
        "op12_ranked_search": lexical_search.ORACLE,
        "op13_decontaminate": decontaminate.ORACLE,
    }
