"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from .audit import OP12_SQL, op12_first_failure_audit
from .chat import OP2_SQL, op2_snapshot_collapse
from .clustering import OP13_SQL, op13_annulus_clustering
from .embeddings import op1_subspace_pigeonhole
from .language import op11_gated_language_model
from .lines import OP7_SQL, op7_line_similarity
from .mixing import op9_hierarchical_mixing
from .packing import op4_bm25_packing
from .pii import op3_bootstrapped_pii
from .quality import OP10_SQL, op10_quality_cascade
from .simhash import op6_simhash_pigeonring
from .tokens import op5_token_records
from .toxicity import op8_naive_bayes_toxicity


def queries():
    found = (
        op1_subspace_pigeonhole,
        op2_snapshot_collapse,
        op3_bootstrapped_pii,
        op4_bm25_packing,
        op5_token_records,
        op6_simhash_pigeonring,
        op7_line_similarity,
        op8_naive_bayes_toxicity,
        op9_hierarchical_mixing,
        op10_quality_cascade,
        op11_gated_language_model,
        op12_first_failure_audit,
        op13_annulus_clustering,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_snapshot_collapse": OP2_SQL,
        "op7_line_similarity": OP7_SQL,
        "op10_quality_cascade": OP10_SQL,
        "op12_first_failure_audit": OP12_SQL,
        "op13_annulus_clustering": OP13_SQL,
    }
