"""References by way of postings: the rows of a look at every text, with texts read for candidates only."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftwell.config import DEFAULT
from siftwell.operators import deltas as dl
from siftwell.operators import lookup as lk
from tests.test_deltas import put

TEXTS = {
    "a": "def getUserToken(x): return get_user(x)",
    "b": "getUserToken (1); GETUSERTOKEN; my_getUserToken; getUserToken2",
    "c": "user.token = 'getUserToken'",
    "d": "$price 12fa3 x12fa3 a-b naïve → café",
    "e": "user . token, b-a, na ve",
    "f": "",
    "g": "user.tokens",
    "h": "one\ttwo  a.b.c\nuser.token(",
    "thing.py": "nothing here",
}
SYMBOLS = ["getUserToken", "get_user", "user", "User", "token", "user.token", "a.b", "a-b", "$price", "price", "12fa3", "fa3", "12", "naïve", "na", "→", "café", "thing", "one two", "user.token(", "absent", "_"]


def rows(found):
    return sorted((r.asked, r.chunk_id, r.hits, r.tier, r.kind) for r in found.collect())


@pytest.mark.parametrize("config", [DEFAULT, replace(DEFAULT, named_most=0), replace(DEFAULT, named_most=0, broadcast_rows=0)], ids=["named", "broadcast", "shuffled"])
def test_same_rows_as_a_full_look(spark, tmp_path, config):
    store = dl.Deltas(spark, str(tmp_path / "i"))
    apart = replace(config, merge_ratio=0.0)
    put(spark, store, {**TEXTS, "a": "getUserToken getUserToken", "gone": "getUserToken absent"}, apart)
    assert len(put(spark, store, TEXTS, apart)) == 2
    chunks, post = store.read("chunks").cache(), store.read("postings").cache()
    symbols = SYMBOLS if config is DEFAULT else ["getUserToken", "user.token", "absent"]
    pruned = dl.union([lk.references(lk.holding(chunks, post, s, config), s).withColumn("asked", F.lit(s)) for s in symbols])
    whole = dl.union([lk.references(chunks, s).withColumn("asked", F.lit(s)) for s in symbols])
    assert rows(pruned) == rows(whole) != []
    assert {"getUserToken", "user.token"} <= {r[0] for r in rows(pruned)} and "absent" not in {r[0] for r in rows(pruned)}


def test_pages_of_candidates_alone_are_read(spark, tmp_path):
    """20,000 chunks in one file: a rare symbol costs the pages that hold it, an absent one no scan."""
    store = dl.Deltas(spark, str(tmp_path / "i"))
    n = 20_000
    text = F.concat(F.lit("common "), F.when(F.col("id") % 9000 == 77, "rare_name").otherwise("other"), F.lit(" w"), F.col("id"), F.repeat(F.lit(" x"), 100))
    chunks = spark.range(0, n, 1, 1).select(F.format_string("f%05d:1", F.lit(n) - F.col("id")).alias("chunk_id"), text.alias("text"), F.lit("s").alias("symbol"))
    made = store.stage()
    store.write(made, "chunks", chunks)
    post = chunks.select("chunk_id", F.explode(F.split("text", " ")).alias("term")).distinct()
    found = lk.references(lk.holding(store.table(made, "chunks"), post, "rare_name"), "rare_name")
    assert found.count() == 3
    qe = found._jdf.queryExecution()
    qe.toRdd().count()
    read = read_rows(qe.executedPlan())
    assert 3 <= read <= 3 * 1000, read
    absent = lk.holding(store.table(made, "chunks"), post, "no_such_name")
    assert absent.count() == 0 and "FileScan" not in absent._jdf.queryExecution().executedPlan().toString()


def read_rows(plan):
    """Rows that the scans of a plan have given."""
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "FileScan" in leaf.toString() or "Scan" in leaf.nodeName():
            total += leaf.metrics().apply("numOutputRows").value()
    return total
