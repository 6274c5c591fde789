"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import fingerprints, media, mixing, packing, quality, secrets, simhash, suffixes, tokenfiles, toxicity
from corpusmill.llm.common import documents
from corpusmill.llm.oracle import SQL

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack_documents(documents(s, d), public_tokenizers.path(BYTE_BPE)),
        "op2_quality_classifier": lambda s, d: quality.score_documents(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op3_source_mixing": lambda s, d: mixing.mix(documents(s, d)),
        "op4_toxicity": lambda s, d: toxicity.score_documents(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op5_secret_scan": lambda s, d: secrets.report(documents(s, d)),
        "op6_simhash_dedup": lambda s, d: simhash.components(documents(s, d)),
        "op7_fingerprints": lambda s, d: fingerprints.fingerprint_edits(documents(s, d)),
        "op8_suffix_dedup": lambda s, d: suffixes.report(documents(s, d)),
        "op9_token_files": lambda s, d: tokenfiles.round_trip(documents(s, d), public_tokenizers.path(WORD_BPE)),
        "op10_media_columns": lambda s, d: media.document_media(documents(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return SQL
