"""Tokenizers: white space as expressions, byte-level vocabularies as Arrow batches, and any of one's own."""

from __future__ import annotations

import base64
import codecs
import hashlib
import importlib
from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, and what is trimmed from a text's ends before that (fewer characters, so a text
#: that begins or ends with another blank has an empty token there).
SEPARATORS = r"[\t-\r \u0085\u00A0\u1680\u180E\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
TRIMMED = r"^[ \n\r\t\x0B\x00]+|[ \n\r\t\x0B\x00]+$"


class InvalidTokenizer(ValueError):
    """A tokenizer that can't be found, lacks a part or isn't one."""


@runtime_checkable
class Tokenizer(Protocol):
    """Pure and deterministic; the identifier goes into the configuration hash."""

    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...

    def identifier(self) -> str: ...


def whitespace_tokens(text: Column) -> Column:
    """The tokens of a text; none for a null, empty or blank one, nor for one that isn't valid UTF-8."""
    trimmed = F.regexp_replace(text, TRIMMED, "")
    return F.when(text.isNull() | (trimmed == "") | ~F.is_valid_utf8(text), F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


class WhitespaceTokenizer:
    """The same in Python."""

    def __init__(self) -> None:
        import re

        self._trim, self._split = re.compile(TRIMMED).sub, re.compile(SEPARATORS).split

    def encode(self, text: str) -> list[str]:
        trimmed = self._trim("", text or "")
        return self._split(trimmed) if trimmed else []

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def identifier(self) -> str:
        return "whitespace"


#: Fixed value: what stands for bytes that are no UTF-8.
_FAULT = "?"
codecs.register_error("marginalia.fault", lambda e: (_FAULT, e.end))


def trim_partial(raw: bytes) -> str:
    """The text of a slice of UTF-8: at most three continuation bytes at its start and a cut-off character at its end go, other faults are replaced."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    start = 0
    while start < min(3, len(raw)) and raw[start] & 0xC0 == 0x80:
        start += 1
    end = len(raw)
    for back in range(1, min(4, end - start) + 1):
        lead = raw[end - back]
        if lead & 0xC0 == 0x80:
            continue
        width = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        if width != back and (width == 0 or width > back):
            end -= back
        break
    return raw[start:end].decode("utf-8", "marginalia.fault")


class VocabularyTokenizer:
    """Byte-level tokens of a public vocabulary file; a slice of tokens decodes without broken characters at its edges.

    raw: the file's bytes, where it has been read elsewhere.
    """

    def __init__(self, path: str, pattern: str | None = None, raw: bytes | None = None) -> None:
        try:
            import tiktoken
        except ImportError as e:
            raise InvalidTokenizer("a vocabulary tokenizer needs the package tiktoken") from e
        file = Path(path)
        if raw is None:
            raw = vocabulary(path)
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}
        # Fixed value: the pattern by which this vocabulary cuts texts.
        pattern = pattern or r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._name = f"{file.stem}:{hashlib.sha256(raw + pattern.encode()).hexdigest()[:16]}"
        self._encoding = tiktoken.Encoding(file.stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text or "")

    def decode(self, tokens: list[int]) -> str:
        return trim_partial(self._encoding.decode_bytes(tokens))

    def identifier(self) -> str:
        """The name of the file and a digest of what it holds, so that another vocabulary is another tokenizer wherever it lies."""
        return f"tiktoken:{self._name}"


#: Bytes a vocabulary may have; it is broadcast.
VOCABULARY_BYTES = 64 << 20


def vocabulary(path: str) -> bytes:
    file = Path(path)
    if not file.exists():
        raise InvalidTokenizer(f"there is no vocabulary {path}")
    if file.stat().st_size > VOCABULARY_BYTES:
        raise InvalidTokenizer(f"vocabulary {path} is larger than {VOCABULARY_BYTES} bytes")
    return file.read_bytes()


#: Vocabularies a process has loaded, by path and content.
_LOADED: dict[tuple[str, str], Tokenizer] = {}


def load_vocabulary(path: str, raw: bytes) -> Tokenizer:
    key = (path, hashlib.sha256(raw).hexdigest())
    if key not in _LOADED:
        _LOADED[key] = VocabularyTokenizer(path, raw=raw)
    return _LOADED[key]


def make_tokenizer(driver: str, path: str | None = None) -> Tokenizer:
    """whitespace, tiktoken (needs a path), or the dotted name of a class of one's own."""
    if driver == "whitespace":
        return WhitespaceTokenizer()
    if driver == "tiktoken" or driver.startswith("tiktoken:"):
        if not path:
            raise InvalidTokenizer("a vocabulary tokenizer needs a path")
        return load_vocabulary(path, vocabulary(path))
    module, _, name = driver.rpartition(".")
    try:
        made = getattr(importlib.import_module(module), name)()
    except (ImportError, AttributeError, ValueError) as e:
        raise InvalidTokenizer(f"there is no tokenizer class {driver!r}") from e
    if not isinstance(made, Tokenizer):
        raise InvalidTokenizer(f"{driver!r} has not the methods of a tokenizer")
    return made
