"""Encoders turn texts into vectors; any object with `dim`, `name` and `encode(list) -> array` will do."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from .operators.search import terms_of


class Encoder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic bag of hashed terms: for tests and for installations without a model."""

    name = "hashing"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for t in terms_of(text):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OnnxEncoder:
    """A sentence encoder from local files: an ONNX model and its tokenizer; digests are checked if given."""

    def __init__(self, model_path: str, tokenizer_path: str, dim: int, sha256: str | None = None, max_tokens: int = 512, tokenizer_sha256: str | None = None):
        for path, digest in ((model_path, sha256), (tokenizer_path, tokenizer_sha256)):
            if digest:
                with open(path, "rb") as f:
                    found = hashlib.file_digest(f, "sha256").hexdigest()
                if found != digest:
                    raise ValueError(f"{path} has digest {found}, not {digest}")
        self.name, self.dim = model_path, dim
        self.paths, self.max_tokens, self.session = (model_path, tokenizer_path), max_tokens, None

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.session is None:  # once a worker
            import onnxruntime
            from tokenizers import Tokenizer

            self.session = onnxruntime.InferenceSession(self.paths[0])
            self.tokenizer = Tokenizer.from_file(self.paths[1])
            self.tokenizer.enable_truncation(self.max_tokens)
            self.tokenizer.enable_padding()
        rows = self.tokenizer.encode_batch(texts)
        given = {"input_ids": np.array([r.ids for r in rows]), "attention_mask": np.array([r.attention_mask for r in rows]), "token_type_ids": np.array([r.type_ids for r in rows])}
        out = self.session.run(None, {i.name: given[i.name] for i in self.session.get_inputs()})[0]
        out = out[:, 0] if out.ndim == 3 else out
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def __getstate__(self):
        return self.__dict__ | {"session": None, "tokenizer": None}


def embed(chunks: DataFrame, encoder: Encoder, batch: int = 256, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(keys, embedding) of (keys, text), keys being strings; a worker loads its encoder once."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield part[list(keys)].assign(embedding=[v.tolist() for v in encoder.encode(part["text"].tolist())])

    return chunks.select(*keys, "text").mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", embedding array<float>")
