"""Sizes of texts in tokens of a public byte-level BPE."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary, a file of base64 tokens and ranks.  Executors read it at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MOST_WORDS = 200_000


class TokenCounter:
    """Counts tokens of whole texts, exactly as encoding them would.

    Merges never cross a blank before a word nor a line break before a word, so counts of words are kept and added.  Texts with runs of white
    space where the splitting rule looks further are encoded whole.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._first: dict[str, int] = {}
        self._later: dict[str, int] = {}

    def _learn(self, known: dict[str, int], words: list[str], lead: str) -> int:
        if len(known) > _MOST_WORDS:
            known.clear()
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = len(self._encode(lead + w))
            total += n
        return total

    def _gaps(self, words: list[str]) -> int:
        """Tokens of a line with runs of blanks: of a run before a word all but the last blank are one piece."""
        total = run = 0
        for i, w in enumerate(words):
            if w:
                if run:
                    total += self._learn(self._first, [" " * run], "")
                total += self._learn(self._later, [w], " ") if i else self._learn(self._first, [w], "")
                run = 0
            else:
                run += 1
        return total + (self._learn(self._first, [" " * run], "") if run else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[-1].isspace():
            return len(self._encode(text))
        lines = text.split("\n")
        total = len(lines) - 1
        for i, line in enumerate(lines):
            if line[:1].isspace() or not line:
                return len(self._encode(text))
            words = line.split(" ")
            if "" in words:
                total += self._gaps(words)
                continue
            try:
                total += self._first[words[0]] + sum(map(self._later.__getitem__, words[1:]))
            except KeyError:
                total += self._learn(self._first, words[:1], "") + self._learn(self._later, words[1:], " ")
        return total


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> TokenCounter:
    """The worker's counter, loaded once."""
    return TokenCounter(vocabulary)


def token_sizes(documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``n_tokens`` of every document.

    Only ``doc_id``, ``text`` and ``keep`` are read.  A null or empty text has 0 tokens; a null ``doc_id`` gives no row; repeated rows give repeated rows.
    """
    src = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), *keep, "text")
    schema = src.drop("text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            sizes = pa.array([c.count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes], [*b.schema.names[:-1], "n_tokens"])

    return src.mapInArrow(measure, schema)
