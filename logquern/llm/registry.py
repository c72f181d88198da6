"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op7_syncmers
from .language import op1_language
from .lines import op8_lines
from .lm import op2_mixing
from .ngrams import op5_ngrams
from .packing import op6_packing
from .pieces import op3_pieces
from .quality import op4_quality
from .topk import OP9_SQL, op9_topk
from .toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_mixing, op3_pieces, op4_quality, op5_ngrams, op6_packing, op7_syncmers, op8_lines, op9_topk, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL}
