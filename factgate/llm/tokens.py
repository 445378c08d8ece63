"""Token counts by a public tokenizer; its folder is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files, overridable by FACTGATE_TOKENIZERS.
FOLDER = os.environ.get("FACTGATE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(folder: str, vocabulary: str):
    import tiktoken

    at = Path(folder)
    if not at.exists() and (spec := importlib.util.find_spec("public_tokenizers")):  # an executor without the folder
        at = Path(spec.origin).parent
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(at / vocabulary, "rb") if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of docs but `text`, and n_tokens. Null and empty texts have 0. Special tokens' names are ordinary text."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())]))
