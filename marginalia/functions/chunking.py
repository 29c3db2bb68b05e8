"""Overlapping token windows: closed form for white space, Arrow batches for other tokenizers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, check_chunking
from marginalia.functions.hashing import content_hash
from marginalia.functions.tokens import Tokenizer, load_vocabulary, make_tokenizer, vocabulary, whitespace_tokens


def chunk_list(tokens: list, max_tokens: int, overlap: int, tokenizer: Tokenizer) -> list[str]:
    """The windows of a token list; the last is the first that reaches the end; none for no tokens."""
    check_chunking(max_tokens, overlap)
    n, step = len(tokens), max_tokens - overlap
    count = 0 if n == 0 else 1 + max(0, -(-(n - max_tokens) // step))
    return [tokenizer.decode(tokens[i * step : i * step + max_tokens]) for i in range(count)]


def whitespace_chunks(text: Column, max_tokens: int, overlap: int) -> Column:
    """The same of a text's white-space tokens as one expression; null and blank texts have no chunk."""
    check_chunking(max_tokens, overlap)
    step = max_tokens - overlap

    def windows(tokens: Column) -> Column:
        last = F.greatest(F.ceil((F.size(tokens) - max_tokens) / step), F.lit(0)).cast("int")
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i * step + 1, max_tokens), " "))
        return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(made)

    # A one-element list names the tokens, so that they are split once.
    return F.element_at(F.transform(F.array(whitespace_tokens(text)), windows), 1)


def _listed(documents: DataFrame, text: str, config: EngineConfig) -> tuple[Column, Column]:
    """(a document's chunks, why it has none): the second is null unless its tokenizer failed on this text."""
    if config.tokenizer == "whitespace":
        return whitespace_chunks(F.col(text), config.max_tokens, config.overlap), F.lit(None).cast("string")
    driver, path, most, overlap = config.tokenizer, config.tokenizer_path, config.max_tokens, config.overlap
    make_tokenizer(driver, path)  # its errors belong on the driver
    # A vocabulary is read by the driver and broadcast: executors need not have the file.
    held = documents.sparkSession.sparkContext.broadcast(vocabulary(path)) if driver.startswith("tiktoken") else None

    @F.pandas_udf("chunks array<string>, error string")
    def listed_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = load_vocabulary(path, held.value) if held else make_tokenizer(driver, path)

        def cut(t: str | None) -> tuple[list[str], str | None]:
            try:
                return (chunk_list(tokenizer.encode(t), most, overlap, tokenizer) if t else []), None
            except Exception as e:  # one text's failure is that of its document
                return [], f"{type(e).__name__}: {e}"

        for texts in batches:
            yield pd.DataFrame([cut(t) for t in texts], columns=["chunks", "error"])

    both = listed_of(F.col(text))
    return both["chunks"], both["error"]


def chunk_errors(documents: DataFrame, keys: list[str], text: str, config: EngineConfig) -> DataFrame:
    """(keys, message): documents on whose text the tokenizer fails; none for white space, which can't."""
    _, error = _listed(documents, text, config)
    return documents.select(*keys, error.alias("message")).where(F.col("message").isNotNull())


def chunks(documents: DataFrame, keys: list[str], text: str, config: EngineConfig) -> DataFrame:
    """(keys, chunk_index, content_hash, text): the chunks of each document; those without tokens, or on which the tokenizer fails, have none."""
    listed, _ = _listed(documents, text, config)
    return documents.select(*keys, F.posexplode(listed).alias("chunk_index", "text")).select(*keys, "chunk_index", content_hash(F.col("text")).alias("content_hash"), "text")
