"""The jobs on copies of a growing feed: only what is new is taken, and reruns give the same."""

import json
import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from jobs import batch_search, command, refresh_index
from siftwell.operators.search import terms_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "\n".join(f"line {n} of a long text, with some words more and {n * 7} at its end" for n in range(200))
FIRST = [(1, "alpha beta\ngamma", "en", "a", 1), (2, LONG, "en", "a", 2), (3, "to be changed", "de", "b", 3), (4, "to be taken out", "de", None, 4), (5, " \n ", "fr", "b", 5), (6, "alpha alpha", None, "b", 6)]
SECOND = [(3, "it was changed, alpha", "de", "b", 3), (4, None, "de", None, 4), (1, "alpha beta\ngamma", "en", "a", 1), (7, "delta alpha", "en", "a", 7), (None, "no id", "en", "a", 8), (9, None, "en", "a", 9), (2, LONG + "\nmore", "en", "a", 2)]
END = [FIRST[0], SECOND[-1], SECOND[0], FIRST[4], FIRST[5], SECOND[3]]


def add(spark, feed, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(str(feed))


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def seen(spark, index):
    return sorted((r.doc_id, r.chunk_id, r.lang, r.text) for r in refresh_index.chunks(spark, str(index)).collect())


def terms(spark, index):
    return sorted((r.term, r.chunk_id, r.tf) for r in refresh_index.postings(spark, str(index)).collect())


@pytest.fixture
def grown(spark, tmp_path):
    """A feed that was indexed twice, the second time after it had grown; what was there after the first run."""
    at = [str(tmp_path / n) for n in ("feed", "index", "checkpoint")]
    add(spark, at[0], FIRST)
    assert refresh_index.run(spark, *at) == len(FIRST)
    before = files(at[1])
    add(spark, at[0], SECOND)
    assert refresh_index.run(spark, *at) == len(SECOND)
    return at, before


def test_a_run_takes_only_what_is_new(spark, grown, tmp_path):
    (feed, index, checkpoint), before = grown
    after = files(index)
    assert {p: after[p] for p in before} == before and all("batch=1" in p for p in set(after) - set(before))
    told = {r.doc_id: r.status for r in refresh_index._table(spark, index, "manifest", refresh_index.MANIFEST).where("batch = 1").collect()}
    assert told == {2: "changed", 3: "changed", 4: "removed", 7: "new"}
    whole = [str(tmp_path / n) for n in ("feed2", "index2", "checkpoint2")]
    add(spark, whole[0], END)
    refresh_index.run(spark, *whole)
    assert seen(spark, index) == seen(spark, whole[1]) and terms(spark, index) == terms(spark, whole[1])
    assert {d for d, *_ in seen(spark, index)} == {1, 2, 3, 6, 7}
    assert all(f"/lang={x}/" in p for p, x in zip(sorted(p for p in after if "/chunks/batch=0/" in p), ["de", "en", "none"]))


def test_reruns_change_nothing(spark, grown):
    (feed, index, checkpoint), _ = grown
    was, held = files(index), seen(spark, index)
    assert refresh_index.run(spark, feed, index, checkpoint) == 0
    assert files(index) == was and seen(spark, index) == held
    add(spark, feed, FIRST[:1] + SECOND[:1])  # what the index has already
    assert refresh_index.run(spark, feed, index, checkpoint) == 2
    assert seen(spark, index) == held


def test_a_lost_batch_runs_again(spark, grown):
    (feed, index, checkpoint), _ = grown
    held, posted = seen(spark, index), terms(spark, index)
    for p in Path(checkpoint, "commits").iterdir():  # as if the driver had been lost before the batch was committed,
        if p.name.strip(".").startswith("1"):
            p.unlink()
    for p in Path(index, "manifest/batch=1").iterdir():  # and before its last table was written
        p.unlink()
    assert {d for d, *_ in seen(spark, index)} == {1, 2, 3, 4, 6}  # what is not in the manifest is not seen
    refresh_index.run(spark, feed, index, checkpoint)
    assert seen(spark, index) == held and terms(spark, index) == posted


def test_another_checkpoint_is_refused(spark, grown, tmp_path):
    (feed, index, _), _ = grown
    held = seen(spark, index)
    with pytest.raises(PySparkException, match="not the one"):
        refresh_index.run(spark, feed, index, str(tmp_path / "other"))
    assert seen(spark, index) == held


def test_batches_are_bounded_and_the_newest_file_wins(spark, tmp_path):
    at = [str(tmp_path / n) for n in ("feed", "index", "checkpoint")]
    for n, text in enumerate(("one", "two", "three")):
        add(spark, at[0], [(1, text, "en", "a", n), (10 + n, text, "en", "a", n)])
        for p in Path(at[0]).glob("*.parquet"):
            if p.stat().st_mtime > 100 * (n + 1):
                os.utime(p, (100 * (n + 1),) * 2)
    refresh_index.run(spark, *at, refresh_index.Settings(files_per_batch=2))
    assert {r[0] for r in refresh_index._table(spark, at[1], "manifest", refresh_index.MANIFEST).select("batch").distinct().collect()} == {0, 1}
    assert [t for d, _, _, t in seen(spark, at[1]) if d == 1] == ["three"]


def test_empty_feeds(spark, tmp_path):
    at = [str(tmp_path / n) for n in ("feed", "index", "checkpoint")]
    add(spark, at[0], [])
    refresh_index.run(spark, *at)
    assert seen(spark, at[1]) == []
    add(spark, tmp_path / "q", [(1, "alpha", "en", "a", 1)])
    spark.sql("select 1L item_id, 'alpha' text").write.parquet(str(tmp_path / "asked"))
    batch_search.run(spark, str(tmp_path / "asked"), at[1], str(tmp_path / "out"))
    assert batch_search.results(spark, str(tmp_path / "out")).count() == 0


def brute(chunks, asked, k, languages=None):
    """(item, lang, rank, chunk, matched) by the textbook, one chunk after the other."""
    docs = {c: Counter(terms_of(f"{text} docs {c.split(':')[0]} block".replace(" docs ", " ", 1))) for _, c, _, text in chunks}
    lang = {c: x for _, c, x, _ in chunks}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for item, text in asked:
        scores = {}
        for c, d in docs.items():
            hits = [t for t in terms_of(text) if t in d]
            s = sum((raw[t] if raw[t] >= 0 else low) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean)) for t in hits)
            if hits and round(s, 9) > 0:
                scores[c] = (round(s, 9), len(set(hits)))
        for x in set(lang.values()) if languages is None else languages:
            best = sorted((-s, c, m) for c, (s, m) in scores.items() if lang[c] == x)[:k]
            out += [(item, x, r, c, m) for r, (_, c, m) in enumerate(best, 1)]
    return sorted(out)


def test_batch_search(spark, grown, tmp_path):
    (_, index, _), _ = grown
    asked = [(1, "alpha alpha words"), (2, "changed delta"), (3, "nothing_of_this"), (4, "line 12 of text"), (None, "alpha"), (6, None)]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(str(tmp_path / "asked"))
    out = str(tmp_path / "out")

    def found():
        return sorted((r.item_id, r.lang, r.rank, r.chunk_id, r.matched) for r in batch_search.results(spark, out).collect())

    want = brute(seen(spark, index), [a for a in asked if None not in a], 3)
    for _ in range(2):
        batch_search.run(spark, str(tmp_path / "asked"), index, out, batch_search.Settings(top_k=3))
        assert found() == want and want
    assert {p.name for p in Path(out).glob("lang=*")} == {f"lang={x}" for x in {w[1] for w in want}}
    was = files(f"{out}/lang=de")
    batch_search.run(spark, str(tmp_path / "asked"), index, out, batch_search.Settings(top_k=1, languages=["en"]))  # others stay
    assert files(f"{out}/lang=de") == was
    assert found() == sorted([w for w in want if w[1] != "en"] + [w for w in want if w[1] == "en" and w[2] == 1])


def test_chunks_carry_their_terms(spark, grown, tmp_path):
    """The terms that a chunk comes with are those of its postings; an index of an earlier version, without them, gives the same answers."""
    (_, index, _), _ = grown
    told = [(t.term, r.chunk_id, t.tf) for r in refresh_index.chunks(spark, index).collect() for t in r.entries]
    assert sorted(told) == terms(spark, index) and all(r.dl == sum(t.tf for t in r.entries) for r in refresh_index.chunks(spark, index).collect())
    spark.createDataFrame([(1, "alpha alpha words"), (2, "changed delta line")], "item_id bigint, text string").write.parquet(str(tmp_path / "asked"))

    def found(at):
        batch_search.run(spark, str(tmp_path / "asked"), at, str(tmp_path / "out"))
        return sorted(tuple(r) for r in batch_search.results(spark, str(tmp_path / "out")).collect())

    old = str(tmp_path / "old")
    for name, schema, parts in (("manifest", refresh_index.MANIFEST, ["batch"]), ("postings", refresh_index.POSTINGS, ["batch", "bucket"]), ("chunks", refresh_index.CHUNKS, ["batch", "lang"])):
        rows = refresh_index._table(spark, index, name, schema)
        rows = rows.where("batch = 0").drop("dl", "entries").unionByName(rows.where("batch > 0"), allowMissingColumns=True) if name == "chunks" else rows
        rows.write.partitionBy(*parts).parquet(f"{old}/{name}")
    want = found(index)
    assert found(old) == want and want


def test_settings_and_command_lines(tmp_path):
    assert command.settings(refresh_index.Settings, str(command.HERE / "refresh_index.json")) == refresh_index.Settings()
    assert command.settings(batch_search.Settings, str(command.HERE / "batch_search.json")).top_k == 10
    (tmp_path / "bad.json").write_text('{"chunk_token": 3}')
    with pytest.raises(ValueError, match="chunk_token"):
        command.settings(refresh_index.Settings, str(tmp_path / "bad.json"))
    (tmp_path / "small.json").write_text(json.dumps({"chunk_tokens": 200, "files_per_batch": 1}))
    go = {"cwd": command.HERE.parent, "capture_output": True, "text": True, "timeout": 300, "env": os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}}
    tables = "/root/testdata/sf0.001"
    first = subprocess.run([sys.executable, "-m", "jobs.refresh_index", f"{tables}/documents.parquet", str(tmp_path / "index"), str(tmp_path / "c"), "--config", str(tmp_path / "small.json")], **go)
    assert first.returncode == 0 and "read 200 rows" in first.stderr and "new" in first.stderr, first.stderr[-2000:]
    second = subprocess.run([sys.executable, "-m", "jobs.batch_search", f"{tables}/benchmark.parquet", str(tmp_path / "index"), str(tmp_path / "out")], **go)
    assert second.returncode == 0 and "lang=en holds" in second.stderr, second.stderr[-2000:]


def test_readers_join_nothing_while_nothing_was_replaced(spark, tmp_path):
    """The postings of a feed that only grows are read as they are; a lost batch is not seen."""
    feed, index, checkpoint = (str(tmp_path / n) for n in ("feed", "index", "checkpoint"))
    add(spark, feed, FIRST)
    refresh_index.run(spark, feed, index, checkpoint)
    whole = terms(spark, index)
    for rows in (refresh_index.postings(spark, index), refresh_index.chunks(spark, index)):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    lost = refresh_index._table(spark, index, "postings", refresh_index.POSTINGS).drop("batch").where("bucket >= 0")
    lost.write.partitionBy("bucket").parquet(f"{index}/postings/batch=7")  # no manifest names it
    assert terms(spark, index) == whole
