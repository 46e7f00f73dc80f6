"""Deltas: live rows and statistics equal those of an index built anew, and a run writes what it changed."""

import os
from collections import Counter
from dataclasses import replace
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from siftwell.config import DEFAULT
from siftwell.operators import deltas as dl
from siftwell.operators import index as ix
from siftwell.plans.engine import Engine

# the same chunk ids come back with other text, a file goes and comes again, one is emptied of terms
STATES = [
    {"a": "red red green", "b": "green blue", "c": "blue", "d": "red"},
    {"a": "red green", "b": "green blue", "d": "red"},
    {"b": "...", "c": "violet blue", "d": "red", "e": "red"},
]


def put(spark, store, state, config):
    rows = spark.createDataFrame([(f"{k}:1", v, k, "", 0) for k, v in state.items()], "chunk_id string, text string, filepath string, symbol string, ord int")
    rows = rows.withColumn("filepath_lc", F.col("filepath")).withColumn("doc_category", F.lit("source_code"))
    at, made = store.versions(), store.stage()
    current = rows.select("filepath", F.sha1("text").alias("sha"), F.lit(None).cast("timestamp").alias("mtime"))
    if at:
        rows = rows.join(ix.diff(store.read("manifest", at), current).where("status in ('new', 'changed')"), "filepath", "left_semi")
    store.write(made, "chunks", rows)
    store.write(made, "vectors", rows.withColumn("embedding", F.array(F.length("text").cast("float"))))
    versions = store.seal(made, at, current, {}, config)
    store.publish(versions[-1], *versions[:-1])
    return versions


@pytest.mark.parametrize("ratio, most", [(0.0, 0), (1e9, DEFAULT.broadcast_rows)])
def test_live_rows(spark, tmp_path, ratio, most):
    store, config = dl.Deltas(spark, str(tmp_path / "i")), replace(DEFAULT, merge_ratio=ratio, broadcast_rows=most)
    assert store.read("chunks") is None and store.current() is None
    for i, state in enumerate(STATES):
        versions = put(spark, store, state, config)
        assert versions == store.versions() and len(versions) == (i + 1 if ratio == 0 else 1)
        live = {r.filepath: r.text for r in store.read("chunks").collect()}
        assert live == state
        assert {r.chunk_id: r.embedding for r in store.read("vectors").collect()} == {f"{k}:1": [len(v)] for k, v in state.items()}
        whole = spark.createDataFrame([(f"{k}:1", v, k, "") for k, v in state.items()], "chunk_id string, text string, filepath string, symbol string")
        post = ix.postings(whole)
        assert sorted(store.read("postings").select("term", "chunk_id", "tf").collect()) == sorted(post.select("term", "chunk_id", "tf").collect())
        stats = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
        assert stats(store.read("term_stats")) == stats(ix.term_stats(post, len(state)))
        meta, sizes = store.read("meta").first(), [r.dl for r in ix.lengths(whole).collect()]
        assert (meta.chunk_count, meta.file_count, meta.dl_total) == (len(state), len(state), sum(sizes)) and meta.avg_dl == pytest.approx(sum(sizes) / len(sizes))
        assert {r.filepath: r.sha for r in store.read("manifest").collect()} == {k: sha1(v.encode()).hexdigest() for k, v in state.items()}
    merged = store.merge(store.versions())
    assert {r.text for r in store.read("chunks", merged).collect()} == set(STATES[-1].values()) and store.table(merged[0], "tombs").isEmpty()


def test_few_versions_for_many_runs(spark, tmp_path):
    store, state = dl.Deltas(spark, str(tmp_path / "i")), {f"f{i}": f"word{i}" for i in range(40)}
    put(spark, store, state, DEFAULT)
    base = store.versions()
    for i in range(3):
        state |= {f"f{i}": f"other{i}"}
        versions = put(spark, store, dict(state), DEFAULT)
        assert versions[0] == base[0] and len(versions) <= 3  # the base, and what is merged by size
    assert {r.filepath: r.text for r in store.read("chunks").collect()} == state


def rows_of(store, version):
    return {t: store.table(version, t).count() for t in ("chunks", "vectors", "doc_len", "manifest", "tombs", "meta")}


def test_a_run_writes_what_it_changed(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(30):
        (root / f"m{i}.py").write_text(f"def run_{i}():\n    return shared({i})\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    assert (e.reindex().new, len(e.store.versions())) == (30, 1)
    assert e.reindex().unchanged == 30 and len(e.store.versions()) == 1  # nothing changed: nothing is published
    (root / "m3.py").write_text("def run_3():\n    return other_word\n")
    os.remove(root / "m4.py")
    done = e.reindex()
    assert (done.unchanged, done.changed, done.removed, done.chunks) == (28, 1, 1, 29)
    base, delta = e.store.versions()
    assert rows_of(e.store, delta) == {"chunks": 1, "vectors": 1, "doc_len": 1, "manifest": 2, "tombs": 2, "meta": 1}
    assert e.search("other_word", top_k=1).first().filepath == "m3.py"
    assert not {"m4.py"} & {r.filepath for r in e.search("shared", top_k=40).collect()}
    assert Counter(r.chunk_id for r in e.store.read("vectors").collect()) == Counter(r.chunk_id for r in e.store.read("chunks").collect())
    os.utime(root / "m5.py", (1, 1))  # touched alone: the manifest takes the time, no chunk is made
    assert e.reindex().unchanged == 29 and e.status().first().changed_count == 0
    assert {r.filepath: r.version for r in e.store.read("manifest").collect()}["m5.py"] == base
    assert e.reindex(full=True).status == "rebuilt" and len(e.store.versions()) == 1
    e.prune()
    assert [p for p in os.listdir(tmp_path / "index") if p.startswith("gen=")] == e.store.versions()
    assert e.search("other_word", top_k=1).count() == 1
