"""The contract queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, divergence, exact_dedup, huffman, minhash, packing, pii, resample, secrets, suffix_tree, toxicity, url_rules, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        exact_dedup.op1_exact_dedup, secrets.op2_secret_battery, packing.op3_mixture_packing, huffman.op4_huffman_files, toxicity.op5_toxicity_chain,
        decontaminate.op6_simhash_decontamination, warc.op7_warc_segments, minhash.op8_minhash_near_dedup, pii.op9_crf_pii, suffix_tree.op10_suffix_tree_scores,
        resample.op11_importance_resampling, url_rules.op12_url_rules, divergence.op13_source_divergence,
    )
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op7_warc_segments": warc.SQL, "op11_importance_resampling": resample.SQL, "op12_url_rules": url_rules.SQL, "op13_source_divergence": divergence.SQL}
