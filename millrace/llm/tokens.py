"""Sizes of texts in tokens of a public byte-level tokenizer.

Its pattern splits a text into pieces before the merges, and no piece crosses the places where blanks begin. So a text's size
is the sum of the sizes of its chunks (a word with the blank before it, or blanks), and those are kept: a chunk is
merged once per worker, not once per occurrence. Counts equal those of encoding the whole text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file, by name (in the folder of the public tokenizers) or as a path.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Chunks a worker keeps; beyond that it starts anew.
KEPT = 400_000

_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters that Python takes for blanks and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str) -> str:
    if Path(name).is_file():
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Counter:
    """Counts tokens; one per worker and vocabulary (``counter``)."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(Path(name).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = _Sizes(self.encoding)

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(text)

    def of_chunks(self, chunks: list[str]) -> int:
        if len(self.sizes) > KEPT:
            self.sizes.clear()
        return sum(map(self.sizes.__getitem__, chunks))

    def plain(self, text: str | None) -> bool:
        """Whether the sizes of the chunks add up to that of the text."""
        return not text or _ODD.search(text) is None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.of_chunks(self.chunks(text)) if self.plain(text) else len(self.encoding.encode_ordinary(text))


class _Sizes(dict):
    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self.encode(chunk))
        return n


@functools.lru_cache(maxsize=4)
def counter(name: str = VOCABULARY) -> Counter:
    return Counter(name)


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., tokens): the size of every text; null and empty texts have 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            sizes = pa.array([count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], sizes], names=[*keep, "tokens"])

    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    names = "".join(f"`{c}` {t}, " for c, t in kept.drop("__text").dtypes)
    return kept.mapInArrow(read, names + "tokens long")
