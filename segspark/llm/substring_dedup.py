"""Substring deduplication by fixed-block anchors.

Every document's words are cut into blocks of half a window, end to end; these reference blocks are
indexed, every rolling window of a block's length probes the index, and a block that something else
hits is extended to all exact repeats of full length around it.  A repeated stretch of 35 words always
contains one whole block of 18, so none is missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Rule, without_repeats
from .textkit import positions

WINDOW = 35


def blocks(grams, first, rule):
    """Probe every position; index the positions that are multiples of the block length."""
    look = positions(first, rule.anchor)
    # stretches that could repeat lie in texts of full length only
    long = np.repeat(np.diff(first) >= rule.length, np.maximum(np.diff(first) - rule.anchor + 1, 0))
    look = look[long]
    text = np.searchsorted(first, look, "right") - 1
    return look, look[(look - first[text]) % rule.anchor == 0]


def rule(window: int = WINDOW) -> Rule:
    return Rule(window, (window + 1) // 2, blocks)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, kept``, a row per row of ``docs``.

    Removes each word covered by a window of ``window`` words whose words also start anywhere else, the
    same document included.  Null and wordless texts have no words; shorter texts lose none; repeated
    rows are repeats of each other.  Extra columns are ignored; an empty table gives no rows.
    """
    got = without_repeats(docs, rule(window), id_col, text_col, with_text, "substring")
    return got.withColumnsRenamed({"id": "doc_id", "sha": "kept_sha256"})


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM w),
k AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM h JOIN k USING (h)),
g AS (SELECT r, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))
