"""Token counts with a whole-token shortcut.

For a byte-level BPE, offline, every vocabulary string is tried alone: it must be a
single pre-token, and encode to exactly its own id. For such strings a matching
pre-token is one token by proof, because merges never cross pre-tokens. Texts are
cut at white space, where a pre-token always ends, and every such chunk into its
pre-tokens; those are looked up and only the rest goes through the merges of the
library's model. What a chunk came to is remembered per worker.

Defined results: null and empty texts have no tokens; special strings inside texts
are one token each, as the library does by default; rows with equal ids stay
separate; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secondpass.llm.common import id_and_text

CACHE_STRINGS = 400_000  # remembered pre-tokens per worker; the memory is emptied when full
LONG_TEXT = 1_000_000  # longer texts are walked instead of split at once
# Pre-token pattern of the byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # Unicode White_Space
# A run without white space with the one space before it, or white space up to the space that belongs to such a run.
CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 stays, others follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in visible}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))})
    return table


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that encode alone as one token, with their ids."""
    tokenizer = Tokenizer.from_file(path)
    pattern, stand_in = regex.compile(PATTERN), _byte_of_char()
    candidates = []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            string = bytes(stand_in[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(string) and pattern.findall(string) == [string]:
            candidates.append((string, number))
    encoded = tokenizer.encode_batch([s for s, _ in candidates], add_special_tokens=False)
    return {s: n for (s, n), e in zip(candidates, encoded) if e.ids == [n]}


class _Cells(dict):
    """Pre-token to value; what was not proved is merged by the library's model on first sight."""

    def __init__(self, model, proved: dict[str, int], value):
        super().__init__({s: value([n]) for s, n in proved.items()})
        self.start, self.proved, self.model, self.value = len(self), proved, model, value
        self.stand_ins = str.maketrans({chr(b): c for c, b in _byte_of_char().items()})

    def __missing__(self, pre: str):
        stood_in = pre.encode().decode("latin-1").translate(self.stand_ins)
        found = self.value([token.id for token in self.model.tokenize(stood_in)])
        if len(pre) <= 64:
            self[pre] = found
        return found

    def trim(self) -> None:
        if len(self) > self.start + CACHE_STRINGS:
            self.clear()
            self.update({s: self.value([n]) for s, n in self.proved.items()})


class _Chunks(dict):
    """Chunk of a text to value, put together from its pre-tokens on first sight."""

    def __init__(self, cells: _Cells, pattern, join):
        super().__init__()
        self.cells, self.pattern, self.join = cells, pattern, join

    def __missing__(self, chunk: str):
        if len(chunk) > LONG_TEXT:
            return self.join(self.cells[m.group()] for m in self.pattern.finditer(chunk))
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isascii() and word.isalpha():  # one pre-token
            found = self.cells[chunk]
        else:
            found = self.join(map(self.cells.__getitem__, self.pattern.findall(chunk)))
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def trim(self) -> None:
        self.cells.trim()
        if len(self) > CACHE_STRINGS:
            self.clear()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """Counts tokens or packs ids (little-endian unsigned 32 bit) of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described["added_tokens"]
        if described["normalizer"] or described["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("normalizers and added spaces are not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens with side conditions are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        tokenizer, proved = Tokenizer.from_file(path), prove_whole_tokens(path)
        pattern = regex.compile(PATTERN)
        self.counts = _Chunks(_Cells(tokenizer.model, proved, len), pattern, sum)
        self.ids = _Chunks(_Cells(tokenizer.model, proved, _pack), pattern, b"".join)

    def _parts(self, text: str):
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)

    def _chunks(self, part: str):
        if len(part) < LONG_TEXT:
            return CHUNK.findall(part)
        return (m.group() for m in CHUNK.finditer(part))

    def count(self, text: str) -> int:
        return sum(
            1 if part in self.special else sum(map(self.counts.__getitem__, self._chunks(part)))
            for part in self._parts(text)
        )

    def pack(self, text: str) -> bytes:
        return b"".join(
            _pack([self.special[part]]) if part in self.special
            else b"".join(map(self.ids.__getitem__, self._chunks(part)))
            for part in self._parts(text)
        )


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file.

    They are kept on the tokenizer library: this module travels to the workers by value, anew with every task.
    """
    kept = tokenizers.__dict__.setdefault("_secondpass_encoders", {})
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``vocabulary`` is the path of the tokenizer file."""

    def count(batches):
        counter = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(2)
            found = [counter.count(text.as_py()) for text in texts]
            counter.counts.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
