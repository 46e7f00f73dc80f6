import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftwell.llm import common as C
from siftwell.llm.substring_dedup import substring_dedup


def brute(rows, k):
    words = [[w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(df, k):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=k).collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(9)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (None, "one two three four five six")]
    for i in range(4, 60):
        w = [rng.choice("abcde") + str(rng.randrange(4)) for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i, rng.choice([" ", "\n", "\t", "  "]).join(w) + rng.choice(["", " "])))
    return rows + [rows[10], (61, rows[20][1]), (62, "é " * 30), (63, "word " * 40_000)]


@pytest.mark.parametrize("k", [1, 3, 7])
def test_against_brute_force(frame, k):
    rows = corpus(k)
    assert run(frame(rows), k) == brute(rows, k)


def test_spans_and_columns(frame):
    out = substring_dedup(frame([(1, "a b c d e f"), (2, "x b c d y")]), window=3)
    assert out.columns == ["doc_id", "text", "kept", "score", "n_words", "n_removed", "removed_spans", "kept_text"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [tuple(s) for s in rows[1].removed_spans] == [(1, 3)] and rows[1].kept_text == "a e f"
    assert substring_dedup(frame([])).count() == 0


def test_one_passage_in_a_third_of_all(frame):
    rows = [(i, (f"u{i} " * 3 + " ".join(f"p{j}" for j in range(40)) if i % 3 == 0 else " ".join(f"v{i}_{j}" for j in range(50)))) for i in range(600)]
    got = {r[0]: r[2] for r in run(frame(rows), 35)}
    assert all(n == (40 if i % 3 == 0 else 0) for i, n in got.items())


def test_equal_rows_are_dealt_to_many_blocks(frame, monkeypatch):
    from siftwell.llm import substring_dedup as S

    monkeypatch.setattr(S, "BLOCK_BYTES", 4096)
    copy = " ".join(f"w{i}" for i in range(20))
    rows = [(7, copy)] * 300 + [(8, None)] * 200 + [(i, f"x{i} " + copy[: i % 60]) for i in range(9, 60)]
    df = frame(rows)
    sizes = [r["count"] for r in S._dealt(df, "text", "block", 16).groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 80
    assert run(df, 5) == brute(rows, 5)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(alphabet="aBé \n\x1f", max_size=30), max_size=8), st.booleans())
def test_words(texts, fold):
    import pyarrow as pa

    h, at = C.words(*C.utf8(pa.array(texts, pa.string())), fold=fold)
    want = [[w for w in re.split(r"[\x20\x09-\x0d]+", t) if w] for t in texts]
    assert [len(w) for w in want] == [b - a for a, b in zip(at[:-1], at[1:])]
    key = [w.replace("B", "b") if fold else w for t in want for w in t]
    assert len(set(h.tolist())) == len(set(key))
    assert len(set(zip(key, h.tolist()))) == len(set(key))
