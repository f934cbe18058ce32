"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hyperminhash, langid, linededup, media, merkle, packing, pii, secrets, spm, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_merkle": merkle.op4_merkle,
    "op5_media": media.op5_media,
    "op6_pii": pii.op6_pii,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_hyperminhash": hyperminhash.op8_hyperminhash,
    "op9_sentencepiece": spm.op9_sentencepiece,
    "op10_language_id": langid.op10_language_id,
}

SQL: dict[str, str] = {"op2_line_dedup": linededup.OP2_SQL, "op4_merkle": merkle.OP4_SQL, "op5_media": media.OP5_SQL, "op7_url_filter": urlfilter.OP7_SQL}
