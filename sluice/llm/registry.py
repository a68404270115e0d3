"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fill_in_middle, jaccard, lexical_search, license_scan, packing, quality_classifier, quality_rules, sharding, tokens, url_filters, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc_revisits": warc.op1_warc_revisits,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_token_files": tokens.op3_token_files,
        "op4_vector_shards": sharding.op4_vector_shards,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_spaced_seed_decontamination": decontaminate.op9_spaced_seed_decontamination,
        "op10_preference_format": chat.op10_preference_format,
        "op11_license_scan": license_scan.op11_license_scan,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": warc.OP1_SQL, "op5_quality_rules": quality_rules.OP5_SQL, "op8_url_filters": url_filters.OP8_SQL,
        "op11_license_scan": license_scan.OP11_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL, "op13_lexical_search": lexical_search.OP13_SQL,
    }
