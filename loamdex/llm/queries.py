"""Queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_dp import op3_bpe
from .language import op4_language
from .order_minhash import op2_near_duplicates
from .packing import op10_packing
from .pii import op5_pii
from .quality import op8_quality
from .secrets import op7_secrets
from .telephony import op9_telephony
from .token_orc import op6_token_orc
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_near_duplicates, op3_bpe, op4_language, op5_pii, op6_token_orc, op7_secrets, op8_quality, op9_telephony, op10_packing)
}
ORACLE_SQL: dict[str, str] = {}
