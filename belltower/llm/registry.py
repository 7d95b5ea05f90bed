"""Queries of the llm operators, with production parameters, and the SQL that checks some of them."""

from __future__ import annotations

import public_tokenizers

from belltower.llm import bpe, decontaminate, fill_middle, html_text, jaccard, language_model, line_dedup, media, pii, quality, resampling, sharding, toxicity
from belltower.llm.common import read

QUERIES = {
    "op1_decontamination": lambda spark, d: decontaminate.query(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op2_media_columns": lambda spark, d: media.digest(read(spark, d, "documents")),
    "op3_language_model": lambda spark, d: language_model.scored(read(spark, d, "documents")),
    "op4_bpe": lambda spark, d: bpe.digest(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op5_line_dedup": lambda spark, d: line_dedup.query(read(spark, d, "documents")),
    "op6_sharding": lambda spark, d: sharding.query(read(spark, d, "documents")),
    "op7_pii": lambda spark, d: pii.personal_data(read(spark, d, "documents")),
    "op8_jaccard_join": lambda spark, d: jaccard.query(read(spark, d, "documents")),
    "op9_html_text": lambda spark, d: html_text.main_text(read(spark, d, "pages")),
    "op10_toxicity": lambda spark, d: toxicity.query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op11_fill_middle": lambda spark, d: fill_middle.query(read(spark, d, "documents")),
    "op12_quality": lambda spark, d: quality.query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op13_resampling": lambda spark, d: resampling.query(read(spark, d, "documents"), read(spark, d, "benchmark")),
}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL}
