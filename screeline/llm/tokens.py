"""Token counts by a public tokenizer whose vocabulary file is given by path."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screeline.llm.topics import packed_words

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of the rank files
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LARGEST_FILE = 64 << 20
_built: dict[int, object] = {}


def _encoding(ranks: bytes):
    """The encoding of a rank file, built once in each Python worker."""
    key = hash(ranks)
    if key not in _built:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _built[key] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
    return _built[key]


def with_tokens(documents: DataFrame, text: str, keep: list[str], path: str = BYTE_BPE, words: bool = False) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the tokens of the whole text (0 for null texts), and
    its distinct hashed words, packed as for topics (null for null texts), if ``words`` is set.

    The driver reads the vocabulary file, of 64 MB at most, and sends it to the tasks, so the
    workers need no copy of it.
    """
    with open(path, "rb") as file:
        ranks = file.read(_LARGEST_FILE + 1)
    if len(ranks) > _LARGEST_FILE:
        raise ValueError(f"{path} is larger than {_LARGEST_FILE} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(ranks)
    extra = ["words"] if words else []
    names = [f"_k{i}" for i in range(len(keep))]
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value)
        for b in batches:
            texts = b.column("_text").to_pylist()
            size = [len(x) for x in encoding.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]
            more = [pa.array(packed_words(texts), pa.binary())] if words else []
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(size, pa.int64()), *more], [*names, "tokens", *extra])

    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(n, rows.schema[n].dataType) for n in names], T.StructField("tokens", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in extra]])
    counted = rows.mapInArrow(count, schema)
    return counted.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "tokens", *extra)
