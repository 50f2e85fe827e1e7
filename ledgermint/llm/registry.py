"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op11_byte_bpe
from .decontam import ORACLE_SQL as OP7_SQL
from .decontam import op7_decontamination
from .html import op6_html_extraction
from .langid import op3_language_id
from .media import op10_media
from .merkle import ORACLE_SQL as OP13_SQL
from .merkle import op13_merkle
from .neardup import ORACLE_SQL as OP4_SQL
from .neardup import op4_near_dedup
from .packing import op2_best_fit_packing
from .pii import op8_pii
from .quality import op5_quality
from .resampling import ORACLE_SQL as OP12_SQL
from .resampling import op12_importance_resampling
from .secrets import op1_secret_scan
from .sharding import op9_sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_language_id": op3_language_id,
        "op4_near_dedup": op4_near_dedup,
        "op5_quality": op5_quality,
        "op6_html_extraction": op6_html_extraction,
        "op7_decontamination": op7_decontamination,
        "op8_pii": op8_pii,
        "op9_sharding": op9_sharding,
        "op10_media": op10_media,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": OP4_SQL, "op7_decontamination": OP7_SQL, "op12_importance_resampling": OP12_SQL, "op13_merkle": OP13_SQL}
