"""Queries of this package and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, debruijn, fim, html, jaccard, langid, mixing, ogg, packing, quality, sharding, tokens, yinyang


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ogg_media": ogg.op1_ogg_media,
        "op2_minimax_shards": sharding.op2_minimax_shards,
        "op3_prefix_targets": chat.op3_prefix_targets,
        "op4_line_field": quality.op4_line_field,
        "op5_chosen_path": jaccard.op5_chosen_path,
        "op6_line_blocks": html.op6_line_blocks,
        "op7_byte_cnn": langid.op7_byte_cnn,
        "op8_token_files": tokens.op8_token_files,
        "op9_swap_packing": packing.op9_swap_packing,
        "op10_water_filling": mixing.op10_water_filling,
        "op11_yinyang_clusters": yinyang.op11_yinyang_clusters,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_compacted_spans": debruijn.op13_compacted_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_prefix_targets": chat.OP3_SQL,
        "op10_water_filling": mixing.OP10_SQL,
        "op11_yinyang_clusters": yinyang.OP11_SQL,
        "op12_fill_in_middle": fim.OP12_SQL,
        "op13_compacted_spans": debruijn.OP13_SQL,
    }
