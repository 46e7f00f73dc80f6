import random
import time

import public_tokenizers
import pytest

from siftwell.llm.pieces import MARK, PieceModel, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def best_score(model, text):
    """Dynamic programming over every substring."""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == 1}
    best = [0.0] + [-1e300] * len(text)
    for s in range(len(text)):
        for e in range(s + 1, min(len(text), s + model.longest) + 1):
            if text[s:e] in ids:
                best[e] = max(best[e], best[s] + model.scores[ids[text[s:e]]])
        if text[s] not in ids:
            best[s + 1] = max(best[s + 1], best[s] + model.unknown)
    return best[-1]


def score(model, text, ids):
    total = pos = k = 0
    while k < len(ids):
        if model.kinds[ids[k]] == 6:
            total, k, pos = total + model.unknown, k + len(text[pos].encode()), pos + 1
        else:
            total, k, pos = total + model.scores[ids[k]], k + 1, pos + len(model.pieces[ids[k]])
    assert pos == len(text)
    return total


def test_model_agrees_with_the_library(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [lib.id_to_piece(i) for i in range(lib.get_piece_size())] == model.pieces
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(259, len(model.pieces)) for _ in range(rng.randrange(1, 9))]
        assert model.decode([model.trie[MARK][""], *ids]) == lib.decode([model.trie[MARK][""], *ids])


def test_viterbi_streams(model):
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice("abcdehlo éñ漢\n\t ,.") for _ in range(rng.randrange(rng.choice([8, 30, 200]))))
        ids = model.encode(text)
        marked = MARK + text.replace(" ", MARK) if text else ""
        assert score(model, marked, ids) == pytest.approx(best_score(model, marked))
        assert model.decode(ids) == text
        for cut in (1, 5, 40):
            assert [i for got in model.stream([marked[j : j + cut] for j in range(0, len(marked), cut)]) for i in got] == ids


def test_commits_before_the_end(model):
    """A text without word ends is still committed as it comes."""
    committed = list(model.stream(["ab" * 5 for _ in range(400)]))
    assert len(committed) > 20 and max(map(len, committed)) < 200


def test_long_texts_come_in_slices(model, monkeypatch):
    """encode() hands over bounded slices, also for texts with runs of spaces; the ids are those of the whole text."""
    sizes, stream = [], model.stream

    def watched(chunks):
        return stream(sizes.append(len(c)) or c for c in chunks)

    rng = random.Random(4)
    for n in (4095, 4096, 4097, 8192, 30_001):
        text = "".join(rng.choice("abcdehlo  é漢\n,.") for _ in range(n))
        whole = [i for ids in stream([MARK + text.replace(" ", MARK)]) for i in ids]
        monkeypatch.setattr(model, "stream", watched)
        assert model.encode(text) == whole
        monkeypatch.undo()
    assert max(sizes) <= 4097


def test_round_trip(frame):
    texts = [None, "", " ", "  two  spaces ", "a\nb", "▁mark ▁", "漢字 é", "word " * 30_000, "x" * 20_000, "same", "same"]
    docs = frame([*enumerate(texts), (None, "no id")])
    enc = encode_pieces(docs, PATH)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in decode_pieces(enc, PATH).collect())
    assert back == sorted([(i, (t or "").replace(MARK, " ")) for i, t in enumerate(texts)] + [(-1, "no id")])
    model = PieceModel(PATH)
    for r in enc.where("length(ids) < 400").collect():
        t = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert [int.from_bytes(r.ids[j : j + 4], "little") for j in range(0, len(r.ids), 4)] == model.encode(t) and r.n_tokens == len(r.ids) // 4
    assert encode_pieces(frame([]), PATH).count() == 0


@pytest.mark.parametrize("part", [" ", "abcde", "a b  ", "é", "wordswithoutspaces"])
def test_long_texts_take_time_in_proportion(model, part):
    """Periodic texts, where back-pointer paths stay apart for long: ids are those of one slice, and no look repeats another."""
    short = part * (3000 // len(part))
    assert model.encode(short) == [i for ids in model.stream([MARK + short.replace(" ", MARK)]) for i in ids]
    spent = []
    for n in (20_000, 40_000, 80_000, 160_000):
        began = time.process_time()
        model.encode(part * (n // len(part)))
        spent.append(time.process_time() - began)
    assert spent[3] < 24 * max(spent[0], 0.05)  # 8 in proportion, 64 if quadratic
