"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe_encoding
from .fingerprints import op2_document_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op6_html_extraction
from .license_scan import OP11_SQL, op11_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import op3_best_fit_packing
from .pu_classifier import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .secret_scan import OP4_SQL, op4_secret_scan
from .simhash_dedup import op9_simhash_near_dedup
from .spelling import OP12_SQL, op12_spelling_variants
from .suffix_tree import op8_suffix_tree_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_bpe_encoding": op5_bpe_encoding,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_tree_scores": op8_suffix_tree_scores,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_license_scan": op11_license_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op4_secret_scan": OP4_SQL,
    "op11_license_scan": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
