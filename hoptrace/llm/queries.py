"""The registered queries of this subpackage and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .filter_audit import op13_filter_audit
from .interleaved import op10_interleaved_media
from .manifest_tree import op12_merkle_manifest
from .mixing import op7_water_filling
from .oracle import ORACLE
from .packing import op6_best_two_fit
from .quality_fm import op2_quality_fm
from .quality_rules import op8_adaptive_rules
from .secret_scan import op1_secret_ownership
from .simhash import op5_simhash_near_dedup
from .spot_signatures import op11_spot_signatures
from .token_store import op4_token_store
from .url_templates import op3_url_templates
from .warc_archive import op9_warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ownership, op2_quality_fm, op3_url_templates, op4_token_store, op5_simhash_near_dedup,
        op6_best_two_fit, op7_water_filling, op8_adaptive_rules, op9_warc_archive, op10_interleaved_media,
        op11_spot_signatures, op12_merkle_manifest, op13_filter_audit,
    )
}

__all__ = ["ORACLE", "QUERIES"]
