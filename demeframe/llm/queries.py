"""Queries of the training-text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_byte_bpe
from .chat import OP6_SQL, op6_chat
from .decontaminate import OP1_SQL, op1_decontaminate
from .jaccard import OP9_SQL, op9_jaccard
from .licenses import op4_licenses
from .lm import op3_kneser_ney
from .pii import op10_pii
from .ppm import op8_language
from .quality import op2_quality
from .records import op7_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_licenses": op4_licenses,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_chat": op6_chat,
    "op7_records": op7_records,
    "op8_language": op8_language,
    "op9_jaccard": op9_jaccard,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op6_chat": OP6_SQL, "op9_jaccard": OP9_SQL}
