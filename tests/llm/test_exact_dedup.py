import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, " ab\t"), (5, None), (6, ""), (7, " \n"), (8, "é x"), (9, "éx"), (10, "long " * 5000), (11, "long" * 5000), (4, " ab\t"), (None, "ab  "), (None, "zz"), (12, "A b")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, t), n in zip(rows, norm):
        groups[n].append((-len(t or ""), -(2**63) if i is None else i))
    out = []
    for (i, t), n in zip(rows, norm):
        length, best = min(groups[n])
        keep = None if best == -(2**63) else best
        out.append((i, keep, len(groups[n]), (i == keep) and len(t or "") == -length, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda n: F.substring(F.sha2(n, 256), 1, 1), lambda n: F.lit("same")])
def test_groups(frame, digest):
    got = exact_dedup(frame(ROWS), digest=digest)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(ROWS)


def test_columns_and_empty(frame):
    out = exact_dedup(frame(ROWS), with_columns=True)
    assert out.columns == ["doc_id", "text", "n_words", "score", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.count() == len(ROWS)
    assert exact_dedup(frame([])).count() == 0


def test_hot_group_with_many_ties(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup(df).where("group_size > 1")
    assert rows.count() == 1000 and rows.where("keep_id = 0").count() == 1000 and rows.where("kept").count() == 1


def test_no_python_in_the_plan(frame):
    plan = exact_dedup(frame(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
