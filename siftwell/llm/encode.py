"""Tokenizing whole texts on the executors, with each distinct space-delimited word encoded once a worker."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000
CACHE_BYTES = 16 << 20
STEP_BYTES = 8 << 20
_SPACED = " [\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
#: Letters that stay one letter under any normalisation in use here; a run of them is one token of the splitting rules.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def slices(col: pa.Array, most: int = STEP_BYTES):
    """(lo, hi) of consecutive rows of a string column that hold at most so many bytes, or one row that holds more."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(col.fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)))
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class WordEncoder:
    """Encodes texts like `Tokenizer.encode(text, add_special_tokens=False)`.

    Strings of special tokens in a text become those tokens, as the library has it; with `text_only` they are text like
    any other.

    The vocabularies' own splitting rules never join characters across a space that follows a non-space and
    precedes one, so a text's ids are those of its words: with `leading_space` a word takes the space before
    it along, otherwise white space counts for nothing. Texts where a space meets more white space go through
    the library whole, as do texts that hold a special string. Known words and their ids are flat arrays of bounded size.
    """

    def __init__(self, path: str, leading_space: bool, text_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens = self.bare.encode_special_tokens = True
        self.plain = self.tok if text_only else Tokenizer.from_file(path)
        self.special = [] if text_only else [(t.content, t.normalized) for t in self.plain.get_added_tokens_decoder().values()]
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Split(" ", "removed")
        self.leading = leading_space
        tokens = self.tok.get_vocab()
        self.edge = np.zeros(max(tokens.values()) + 1, bool)
        self.edge[[i for t, i in tokens.items() if (t.startswith("\u0120") if leading_space else t.endswith("</w>"))]] = True
        self.dot, self.comma = (int(np.frombuffer(x, np.uint32)[0]) for x in self.whole([".", ","]))
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.at = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.used = np.zeros(0, bool)

    def _trim(self) -> None:
        """Forget the words that were not met again since the last time, or all if that is not enough."""
        keep = np.flatnonzero(self.used)
        if not 0 < len(keep) < CACHE_WORDS // 2:
            return self._forget()
        size = self.at[keep + 1] - self.at[keep]
        self.ids, self.at = self.ids[spans(self.at[keep], size)], np.concatenate(([0], np.cumsum(size)))
        self.known, self.used = self.known.take(pa.array(keep)), np.zeros(len(keep), bool)

    @staticmethod
    def _all(tok, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._all(self.plain, texts)

    def _odd(self, col: pa.Array) -> np.ndarray:
        """The texts that words cannot be told apart in: white space meets, or a special string is met."""
        found = [pc.match_substring_regex(col, _SPACED)] if self.leading else []
        found += [pc.match_substring(col, x, ignore_case=folds) for x, folds in self.special]
        return np.flatnonzero(np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in found])) if found else np.zeros(0, np.int64)

    def _words(self, words: pa.Array) -> list[bytes]:
        """ids of words, many to a call where a vocabulary marks a word's first or last token, so that ids tell words apart.

        Words of ASCII letters are one token of the splitting rules, and no rule changes them.
        """
        ascii_, ws = pc.match_substring_regex(words, "^[A-Za-z]+$").to_numpy(zero_copy_only=False), words.to_pylist()
        joint = pc.not_equal(words, "") if self.leading else pc.match_substring_regex(words, f"^{_LETTER}+$")
        joint, out = joint.to_numpy(zero_copy_only=False), [b""] * len(ws)
        alone = np.flatnonzero(~joint).tolist()
        for k, ids in zip(alone, self._all(self.tok, [(" " if self.leading else "") + ws[k] for k in alone])):
            out[k] = ids
        for tok, mask, put in ((self.bare, ascii_, "\u0120" if self.leading else ""), (self.tok, joint & ~ascii_, " " if self.leading else "")):
            many, gap = np.flatnonzero(mask).tolist(), " " + put if tok is self.bare else " "
            for lo in range(0, len(many), 256):
                part = many[lo : lo + 256]
                raw = self._all(tok, [put + gap.join([ws[k] for k in part])])[0]
                ids = np.frombuffer(raw, np.uint32)
                edge = np.flatnonzero(self.edge[ids])
                cut = [*(4 * edge).tolist(), 4 * len(ids)] if self.leading else [0, *(4 * (edge + 1)).tolist()]
                if len(cut) != len(part) + 1:
                    raise ValueError("the vocabulary does not mark words as expected")
                for k, a, b in zip(part, cut[:-1], cut[1:]):
                    out[k] = raw[a:b]
        return out

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of words, one after the other, and their bounds; a full stop or comma after a letter is a token of its own."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.leading:  # that vocabulary folds case
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        mark = pc.match_substring_regex(words, f"{_LETTER}[.,]$")
        core = pc.if_else(mark, pc.utf8_slice_codeunits(words, 0, -1), words)
        if len(self.known) > CACHE_WORDS or self.known.nbytes > CACHE_BYTES:
            self._trim()
        found = pc.index_in(core, value_set=self.known)
        missing, of = pc.is_null(found).to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy().astype(np.int64)
        self.used[of[~missing]] = True
        if missing.any():
            coded = core.filter(pa.array(missing)).dictionary_encode()
            of[missing] = len(self.known) + coded.indices.to_numpy()
            ids = self._words(coded.dictionary)
            self.known, self.ids = pa.concat_arrays([self.known, coded.dictionary]), np.concatenate((self.ids, np.frombuffer(b"".join(ids), np.uint32)))
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.at, self.used = np.concatenate((self.at, self.at[-1] + np.cumsum(size))), np.concatenate((self.used, np.zeros(len(ids), bool)))
        mark = mark.to_numpy(zero_copy_only=False)
        start, size = self.at[of], self.at[of + 1] - self.at[of]
        end = np.cumsum(size + mark)
        out = np.empty(int(end[-1]), np.uint32)
        out[spans(end - size - mark, size)] = self.ids[spans(start, size)]
        comma = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)
        out[end[mark] - 1] = np.where(comma[mark], self.comma, self.dot)
        return out, np.concatenate(([0], end))

    def _step(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(col)
        extra = self.whole(col.take(pa.array(odd)).to_pylist()) if len(odd) else []
        if len(odd):
            keep = np.ones(len(col), bool)
            keep[odd] = False
            col = pc.if_else(pa.array(keep), col, "")
        lists = pc.split_pattern(col if self.leading else pc.replace_substring(col, "\n", " "), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        known = len(coded.dictionary)
        ids, bound = self._lookup(coded.dictionary.cast(pa.large_string()))
        code[at[odd]] = known + np.arange(len(odd))
        if self.leading:  # the first word of a text has no space before it
            rest = np.setdiff1d(np.arange(len(col)), odd)
            first = lists.flatten().take(pa.array(at[rest])).dictionary_encode()
            code[at[rest]] = first.indices.to_numpy() + known + len(odd)
            extra += self.whole(first.dictionary.to_pylist())
        more = np.fromiter(map(len, extra), np.int64, len(extra)) // 4
        ids, bound = np.concatenate((ids, np.frombuffer(b"".join(extra), np.uint32))), np.concatenate((bound, bound[-1] + np.cumsum(more)))
        size = np.diff(bound)[code]
        return ids[spans(bound[code], size)], np.concatenate(([0], np.cumsum(size)))[at]

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string column, one text after the other, and the n + 1 bounds; null is empty."""
        col = col.fill_null("").cast(pa.large_string())
        ids, bounds = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for lo, hi in slices(col):
            a, b = self._step(col.slice(lo, hi - lo))
            ids.append(a)
            bounds.append(b[1:] + bounds[-1][-1])
        return np.concatenate(ids), np.concatenate(bounds)

    def encode_ended(self, col, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with end_id after the ids of each text."""
        ids, bounds = self.encode(col)
        ended = bounds + np.arange(len(bounds))
        out = np.full(int(ended[-1]), end_id, np.uint32)
        size = np.diff(bounds)
        out[spans(ended[:-1], size)] = ids
        return out, ended


@lru_cache(maxsize=4)
def encoder(path: str, leading_space: bool, text_only: bool = False) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    return WordEncoder(path, leading_space, text_only)
