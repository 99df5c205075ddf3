"""The corpus pipeline: rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet to the shared folder
and read again for the next stage. All but the last return the columns of documents. No stage keeps what
an earlier one rejected.

Defined cases: null and empty texts fail the rules and go; null ids and null sources are kept like others; of repeated
rows one stays; extra columns go along to the last stage, which gives counts and digests; an empty table gives no rows.
"""

from __future__ import annotations

from candlewick.llm import bpe, mixing, near_copies, quality_rules, secrets
from candlewick.llm.common import materialize, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", near_copies.stage),
    ("secret_scan", secrets.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL has neither the balanced sample nor the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
