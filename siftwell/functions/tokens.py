"""Exact token counts by a tokenizer file, loaded once a worker; where white space parts words, each distinct word is counted once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def tokenizer(path: str, sha256: str | None = None):
    """The tokenizer of a file that every worker can read, without truncation or padding; its digest is checked if given."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        data = f.read()
    found = hashlib.sha256(data).hexdigest()
    if sha256 and found != sha256:
        raise ValueError(f"{path} has digest {found}, not {sha256}")
    out = Tokenizer.from_buffer(data)
    out.no_truncation()
    out.no_padding()
    return out


# Normalizers that change nothing across a space, and a splitter that drops spaces, joins nothing across one and parts letters from marks.
_NORMAL = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_WORD, _MARKED = re.compile(_LETTERS), re.compile(f"({_LETTERS})([!-&(-/:-@\\[-`{{-~]+)")
_JOINED = re.compile(r"[^A-Za-z0-9 \n\t\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,][ \n]")  # where a full stop or comma may be of one token with what is before it
_WORDS, _CHARS = 800_000, 16 << 20  # that a worker keeps at most, beside those of the texts at hand
_STEP, _CALL = 1 << 20, 256  # characters of the texts that are parted into words at a time; words to a call of the tokenizer


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or splitter, those of sequences one after the other."""
    if not part:
        return []
    return [y for x in part[inner] for y in _steps(x, inner)] if part["type"] == "Sequence" else [part]


def by_words(spec: dict) -> bool:
    """Whether the tokens of any text are those of the words between its spaces, by the parts of a tokenizer file."""
    normal, (first, *rest) = _steps(spec.get("normalizer"), "normalizers"), _steps(spec.get("pre_tokenizer"), "pretokenizers") or [None]
    fine = first == _SPLIT and all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in rest)
    fine &= all(n in _NORMAL for n in normal) and not spec["model"].get("dropout")
    return fine and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counter:
    """Counts tokens of texts, those included that the tokenizer puts around a text.

    Where spaces part words (by_words), each word goes to the tokenizer once and is kept; words that were not met for
    long are forgotten. Other tokenizers get texts whole.
    """

    def __init__(self, tok):
        spec = json.loads(tok.to_str())
        self.tok, self.words, self.around = tok, by_words(spec), tok.num_special_tokens_to_add(False)
        self.known, self.old, self.chars = {"": 0}, {}, 0
        self.folds = {"type": "Lowercase"} in _steps(spec.get("normalizer"), "normalizers")
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        self.ends = None  # by id, whether a token is the last of a word, where a vocabulary tells
        if self.words and (end := spec["model"].get("end_of_word_suffix")):
            vocab = tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[n for t, n in vocab.items() if t.endswith(end)]] = True

    def _whole(self, texts: list[str], around: bool = True) -> list[int]:
        found = []
        for at in range(0, len(texts), _CALL):  # what the tokenizer gives is larger than the texts
            found += [len(e) for e in self.tok.encode_batch_fast(texts[at : at + _CALL], add_special_tokens=around)]
        return found

    def _plain(self, words: list[str]) -> list[int]:
        """Tokens of words of letters, many words to a text."""
        found = []
        for at in range(0, len(words), _CALL):
            part = words[at : at + _CALL]
            ends = np.flatnonzero(self.ends[self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids])
            found += np.diff(ends, prepend=-1).tolist() if len(ends) == len(part) else self._whole(part, False)
        return found

    def _keep(self, new: set[str]) -> None:
        """Count new words, or take over the counts of those that were met before."""
        again = {w for w in new if w in self.old}  # an intersection would walk through all that is kept
        self.known |= zip(again, map(self.old.__getitem__, again))
        new -= again
        plain = [w for w in new if _WORD.fullmatch(w)] if self.ends is not None else []
        self.known |= zip(plain, self._plain(plain))
        rest = list(new.difference(plain))
        self.known |= zip(rest, self._whole(rest, False))

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > _WORDS // 2 or self.chars > _CHARS // 2:
            self.old, self.known, self.chars, new = self.known, {"": 0}, 0, words - {""}
        self.chars += sum(map(len, new))
        marked = [(w, *m.groups()) for w in new if (m := _MARKED.fullmatch(w))]  # letters and the marks after them are words of their own
        new.difference_update(w for w, *_ in marked)
        self._keep(new.union(*(m[1:] for m in marked)).difference(self.known))
        self.known |= ((w, self.known[a] + self.known[b]) for w, a, b in marked)

    def _parted(self, text: str) -> list[str]:
        """The words of a text; texts within Latin-1 are first put in lower case, if that counts for nothing, and lose the marks after words."""
        if _latin(text) and not any(t in text.lower() for t in self.special):
            text = text.lower() if self.folds else text
            if not _JOINED.search(text):
                for mark in (". ", ", ", ".\n", ",\n"):
                    text = text.replace(mark, " " + mark)
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def _steps(self, texts: list[str]) -> Iterator[list[str]]:
        """The texts some at a time, as many as hold _STEP characters, or one that holds more."""
        at = size = 0
        for n, t in enumerate(texts):
            if n > at and size + len(t) > _STEP:
                yield texts[at:n]
                at, size = n, 0
            size += len(t)
        yield texts[at:]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.words:
            return self._whole(texts)
        found = []
        for some in self._steps(texts):
            split = [self._parted(t) for t in some]
            try:
                found += self._sums(split)
            except KeyError:
                self._learn(set().union(*split))
                found += self._sums(split)
        return found

    def _sums(self, split: list[list[str]]) -> list[int]:
        return [sum(map(self.known.__getitem__, words)) + self.around for words in split]


@lru_cache(maxsize=4)
def counter(path: str, sha256: str | None = None) -> Counter:
    """One counter a worker and tokenizer file."""
    return Counter(tokenizer(path, sha256))


@lru_cache(maxsize=64)
def count(text: str, path: str, sha256: str | None = None) -> int:
    """Tokens of a text, those included that the tokenizer puts around it."""
    return counter(path, sha256).counts([text])[0]


def count_column(text: Column, path: str, sha256: str | None = None) -> Column:
    """count() of a column; null gives null."""

    @F.pandas_udf("bigint")
    def counts(texts: pd.Series) -> pd.Series:
        given = texts[texts.notna()]
        found = counter(path, sha256).counts(given.tolist())
        return pd.Series(found, given.index, "Int64").reindex(texts.index)

    return counts(text)
