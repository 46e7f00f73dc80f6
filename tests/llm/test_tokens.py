"""The word-wise encoder, token files and packing against the tokenizers library."""

import random
import sys
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm import encode
from siftwell.llm.encode import WordEncoder
from siftwell.llm.packing import _Packer, differencing, pack_sequences, windows_for
from siftwell.llm.token_files import Shard, read_token_table, write_shard, write_token_table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a  b   c", " a b ", " \n b\n c\n\n d", " ", "", None, "a  b  c  ", "it's 'S <|endoftext|> x", " 's ok's", "é ́x", "Σ ΑΣ ΑΣ. ÀÉ", "a b　c \x85 d \x0b e", "tab\tand\nline", "end. end, x.y 1. é. A.",
    "<|startoftext|> a", "İstanbul ŞEHİR", "word " * 20_000, "x" * 5000, "same", "same", "\x00 \x01", "ﬁ ǅ 漢字,",
]


def library(path, text_only=False):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = text_only
    return tok


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_encoder_is_the_library(path, lead):
    enc, tok = WordEncoder(path, lead), library(path)
    ids, at = enc.encode(pa.array(ODD))
    for k, t in enumerate(ODD):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


@pytest.mark.parametrize("text_only", [False, True])
@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_special_strings(path, lead, text_only):
    """Strings of special tokens are those tokens, as the library has it, or text if that is asked for."""
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [end, f"a{end}b", f" {end} x {start}", f"é{end}.", end * 3, "<|ENDOFTEXT|> a", "<|endoftext", f"word {end}\n", "plain words, here.", None, ""]
    enc, tok = WordEncoder(path, lead, text_only), library(path, text_only)
    ids, at = enc.encode(pa.array(texts))
    got = [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert (len(got[0]) == 1) is not text_only


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAB.,'s1 \n\t éß'!<|>-  ́")), max_size=40), max_size=6))
def test_encoder_on_any_text(texts):
    for path, lead in ((BYTES, True), (WORDS, False)):
        enc, tok = _cached(path, lead)
        ids, at = enc.encode(pa.array(texts, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_every_letter_before_a_mark(path, lead):
    """Letters that a vocabulary's normaliser takes apart are not followed by the mark alone."""
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [" ".join(f"{c}{m}" for c in letters[i : i + 50]) for m in (".", ",", ". x") for i in range(0, len(letters), 50)]
    enc, tok = _cached(path, lead)
    ids, at = enc.encode(pa.array(texts))
    for k, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids, texts[k]


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(encode, "CACHE_WORDS", 50)
    enc, tok = WordEncoder(WORDS, False), library(WORDS)
    rng = random.Random(2)
    for _ in range(12):
        texts = [" ".join(f"{rng.choice('abc')}x{chr(97 + rng.randrange(26))}{rng.choice(['', '.', 'é'])}" for _ in range(20)) for _ in range(8)]
        ids, at = enc.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert len(enc.known) < 50 + 8 * 20


_KEPT = {}


def _cached(path, lead):
    if path not in _KEPT:
        _KEPT[path] = (WordEncoder(path, lead), library(path))
    return _KEPT[path]


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 1 << 16, 1 << 20, 1 << 32])
def test_shard_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint32)
    ids[: n // 50] = (1 << 32) - 1  # outliers
    shard = Shard(write_shard(np.array([7, 9]), np.array([0, n // 2, n]), ids))
    assert (shard.read(0, n) == ids).all() and shard.doc_ids.tolist() == [7, 9] and shard.starts.tolist() == [0, n // 2]
    for a, b in ((n // 3, n // 2), (0, n // 4), (n // 4, n), (n, n)):
        assert (shard.read(a, b) == ids[a:b]).all()


def test_exceptions_keep_blocks_narrow():
    ids = np.full(100 * 1024, 5, np.uint32)
    ids[::100] = 1 << 30
    assert len(write_shard(np.array([1]), np.array([0, len(ids)]), ids)) < 1.2 * len(ids) * 6 / 100 + 4 * 100 * 1024 * 3 / 32


def test_table_round_trip(frame):
    rng = random.Random(3)
    rows = [*enumerate(ODD), (None, "none"), (5, "again")]
    rng.shuffle(rows)
    out = read_token_table(write_token_table(frame(rows), BYTES, True, 2)).collect()
    tok = library(BYTES)
    want = sorted((-(2**63) if i is None else i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    got = sorted(out, key=lambda r: r.start)
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in out) == want
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in out], key=lambda i: -(2**63) if i is None else i)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert read_token_table(write_token_table(frame([]), BYTES, True, 2)).count() == 0


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 8))
def test_differencing_deals_every_item_once(sizes, k):
    dealt = differencing(sizes, k)
    assert len(dealt) == k and sorted(i for w in dealt for i in w) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(50, 512) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in differencing(sizes, 40)]
    assert max(sums) - min(sums) <= 20
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows_for(sizes, 2048))
    assert [len(w) for w in windows_for([5, 5, 5], 6)] == [1, 1, 1]  # the count rises above the least possible


@given(st.lists(st.integers(1, 70), max_size=30))
def test_packer_covers_documents(sizes):
    p = _Packer(16, 5, 4)
    for d, n in enumerate(sizes):
        p.add(d, n)
    p.close()
    at = {d: 0 for d in range(len(sizes))}
    for doc, start, n, _, _ in sorted(p.rows):
        assert start == at[doc]
        at[doc] += n
    assert list(at.values()) == sizes
    for s in {r[3] for r in p.rows}:
        mine = sorted((r[4], r[2]) for r in p.rows if r[3] == s)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist() and sum(n for _, n in mine) <= 16


def test_many_small_pieces_take_little_memory():
    tracemalloc.start()
    p = _Packer(2048, 512, 96)
    for d in range(200_000):
        p.add(d, 1)
    p.close()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6 and len(p.rows) == 200_000
    assert max(r[4] for r in p.rows) < 2048 and len({r[3] for r in p.rows}) <= 99


def test_shards_refuse_blocks_that_overflow():
    with pytest.raises(ValueError):
        write_shard(np.array([1]), np.array([0, 1]), np.ones(1, np.uint32), block=1 << 16)


def test_pack_sequences(frame):
    rows = [*enumerate(ODD), (None, "none"), *((100 + i, "some words here " * (i % 97)) for i in range(300))]
    out = pack_sequences(frame(rows), WORDS, False, 1, capacity=256, piece=64, group_windows=8).collect()
    tok = library(WORDS)
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    at = dict.fromkeys(want, 0)
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(r.ids) == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(w) for i, w in want.items()}
    total = {}
    for r in out:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 256 and sum(total.values()) / 256 / len(total) > 0.95
    assert pack_sequences(frame([]), WORDS, False, 1).count() == 0
