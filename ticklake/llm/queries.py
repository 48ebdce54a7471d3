"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, quality, spelling, warc
from .decontamination import op6_decontamination
from .html_text import op3_html_text
from .line_dedup import op9_line_dedup
from .near_dup import op10_near_dup
from .piece_encoding import op7_piece_encoding
from .quality import op8_quality
from .sharding import op1_shuffle_shards
from .spelling import op11_spelling_variants
from .suffix_dedup import op2_suffix_dedup
from .token_alignment import op12_token_alignment
from .token_counts import op5_token_counts
from .toxicity import op4_toxicity
from .warc import op13_warc_archive


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_shuffle_shards, op2_suffix_dedup, op3_html_text, op4_toxicity, op5_token_counts,
        op6_decontamination, op7_piece_encoding, op8_quality, op9_line_dedup, op10_near_dup, op11_spelling_variants, op12_token_alignment,
        op13_warc_archive,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontamination.ORACLE, "op8_quality": quality.ORACLE, "op9_line_dedup": line_dedup.ORACLE,
        "op11_spelling_variants": spelling.ORACLE, "op13_warc_archive": warc.ORACLE,
    }
