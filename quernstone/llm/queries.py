"""The queries of this subpackage and their SQL; each applies its operator to the whole of its table."""

from __future__ import annotations

from . import licenses, urls
from .common import table
from .decontam import op5_decontamination
from .licenses import op6_licenses
from .mixing import op3_mixing
from .ngram_join import op10_ngram_join
from .pii import op1_pii
from .quality import ABLATION_SQL, OP9_SQL, POLICIES, ablation, ledger, op9_quality
from .secrets import op7_secrets
from .sharding import op2_sharding
from .toxicity import op8_toxicity
from .urls import op4_url_filter

QUERIES = {
    "op1_pii": lambda spark, d: op1_pii(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: op4_url_filter(table(spark, d, "pages")),
    "op7_secrets": lambda spark, d: op7_secrets(table(spark, d, "documents")),
    "op2_sharding": lambda spark, d: op2_sharding(table(spark, d, "documents")),
    "op3_mixing": lambda spark, d: op3_mixing(table(spark, d, "documents")),
    "op5_decontamination": lambda spark, d: op5_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_ngram_join": lambda spark, d: op10_ngram_join(table(spark, d, "documents")),
    "op6_licenses": lambda spark, d: op6_licenses(table(spark, d, "documents")),
    "op8_toxicity": lambda spark, d: op8_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_quality": lambda spark, d: op9_quality(table(spark, d, "documents")),
    "quality_ablation": lambda spark, d: ablation(ledger(table(spark, d, "documents").select("doc_id", "text")), POLICIES["v1"]),
}
ORACLE_SQL = {"op4_url_filter": urls.oracle_sql(), "op6_licenses": licenses.oracle_sql(), "op9_quality": OP9_SQL, "quality_ablation": ABLATION_SQL}
