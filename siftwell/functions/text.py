"""Text functions as Columns: terms, token estimates, query shape, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, QUESTION_WORDS, EngineConfig
from . import tokens

# What a term is, and where camelCase words are cut.
WORD = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
HUMP = "[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"


def tokenize(text: Column) -> Column:
    """Terms of code and prose, duplicates kept: each word in lower case, its snake_case parts, its camelCase parts.

    null gives null. Digits are ASCII digits.
    """

    def terms(word: Column) -> Column:
        low = F.lower(word)
        none = F.array().cast("array<string>")
        snake = F.when(word.contains("_"), F.filter(F.split(low, "_"), lambda p: p != "")).otherwise(none)
        humps = F.transform(F.regexp_extract_all(word, F.lit(HUMP), F.lit(0)), F.lower)
        camel = F.when(word.rlike("[a-z]") & word.rlike("[A-Z]") & (F.size(humps) > 1), humps).otherwise(none)
        return F.concat(F.array(low), snake, camel)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), terms))


def token_count(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Tokens by the tokenizer file if one is set, else by the encoder's worst case of characters a token."""
    if config.tokenizer:
        return tokens.count_column(text, config.tokenizer, config.tokenizer_sha256)
    return (F.floor(F.char_length(text) / F.lit(config.least_chars_per_token)) + 1).cast("bigint")


def token_estimate(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """A cheap estimate for texts that cannot exceed the budget, token_count for the rest.

    With a tokenizer, those are the texts with no more bytes than tokens are allowed: a token stands for a byte at least.
    """
    n = F.char_length(text)
    small = F.octet_length(text) + config.tokens_around <= config.chunk_tokens if config.tokenizer else n < config.short_text
    rest = F.when(~small, text) if config.tokenizer else text  # the tokenizer does not see the others
    return F.when(small, (F.floor(n / F.lit(config.chars_per_token)) + 1).cast("bigint")).otherwise(token_count(rest, config))


def density(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Characters a token, at least 1."""
    return F.greatest(F.lit(1.0), F.char_length(text) / token_count(text, config))


def split_budget(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Characters that a part of an oversize chunk may hold."""
    return F.greatest(F.lit(config.split_floor), F.floor(config.chunk_tokens * density(text, config) * F.lit(config.split_share)).cast("int"))


def query_shape(query: Column) -> Column:
    """identifier, natural or mixed."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    n = F.size(words)
    plain = F.forall(words, lambda w: w.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))
    telling = F.exists(words, lambda w: w.contains("_") | (F.lower(w) != w) | ~w.rlike("[a-z]") | (F.char_length(w) > 12))
    asked = F.size(F.filter(words, lambda w: F.regexp_replace(F.lower(w), r"^[?.,]+|[?.,]+$", "").isin(*QUESTION_WORDS)))
    return F.when(n.between(1, 2) & plain & telling, "identifier").when((n >= 4) & (asked >= 2), "natural").otherwise("mixed")


def shape_weights(shape: Column, config: EngineConfig = DEFAULT) -> Column:
    """struct(dense, lexical) for a query shape."""
    out = F.lit(None).cast("struct<dense:double,lexical:double>")
    for name, (d, x) in config.weights.items():
        out = F.when(shape == name, F.struct(F.lit(d).alias("dense"), F.lit(x).alias("lexical"))).otherwise(out)
    return out


def query_prefix(model: str) -> str:
    """What the encoder family expects before a query; passages go bare."""
    name = model.lower()
    if "bge" in name or "arctic" in name:
        return "Represent this sentence for searching relevant passages: "
    return "query: " if "e5" in name else ""


def lines(content: Column) -> Column:
    """Lines without their ends; a final line end makes no empty last line."""
    text = F.when(content.contains("\r"), F.regexp_replace(content, "\r\n?", "\n")).otherwise(content)
    text = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    return F.when(F.char_length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def trim_lines(text: Column) -> Column:
    """Without line ends at either edge."""
    return F.btrim(text, F.lit("\n"))


def word_hits(text: Column, word: str) -> Column:
    """How often a word stands alone, in any case; characters of identifiers are ASCII letters, digits and _."""
    return F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9_]){literal(word)}(?![A-Za-z0-9_])"))


def literal(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)
