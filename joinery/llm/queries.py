"""The registered queries of this folder: one an operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html, leaks, licenses, nearcopies, oracles, substrings, tokenfiles, toxicity, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": lambda s, d: html.digests(table(s, d, "pages")),
        "op2_token_files": lambda s, d: tokenfiles.digests(table(s, d, "documents"), _tokenizer()),
        "op3_warc": lambda s, d: warc.digests(table(s, d, "pages")),
        "op4_nearest_neighbours": lambda s, d: ann.every_hundredth(table(s, d, "embeddings")),
        "op5_license_scan": lambda s, d: licenses.digests(table(s, d, "documents")),
        "op6_near_duplicates": lambda s, d: nearcopies.groups(table(s, d, "documents"), shingle=2),
        "op7_decontamination": lambda s, d: leaks.digests(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_bpe": lambda s, d: bpe.digests(table(s, d, "documents"), _tokenizer()),
        "op9_substring_dedup": lambda s, d: substrings.digests(table(s, d, "documents")),
        "op10_toxicity": lambda s, d: toxicity.grades(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": oracles.warc(),
        "op5_license_scan": licenses.oracle_sql(),
        "op6_near_duplicates": oracles.near(),
        "op7_decontamination": oracles.leaks(),
        "op9_substring_dedup": oracles.substrings(),
    }
