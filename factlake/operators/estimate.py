"""Token estimates of chat prompts: what a request will be billed for, before it is sent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a prompt, and of a message, besides its role and content.
PROMPT, MESSAGE = 3, 4


def prompt_tokens(messages: DataFrame, ranks: str, pattern: str, *, by: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(by, n_messages, n_tokens): 3, and for every message 4 and the tokens of its role and its text.

    ``ranks`` is a file of byte-level BPE ranks (base64 token and rank a line) that every task can
    read, ``pattern`` what texts are split by first. Special tokens in a text count as plain text; null counts as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for b in batches:
            n = [MESSAGE + len(encode(r or "")) + len(encode(t or "")) for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["by", "n"])

    kind = messages.schema[by].dataType.simpleString()
    each = messages.select(F.col(by).alias("by"), role, text).mapInArrow(count, f"by {kind}, n long")
    return each.groupBy(F.col("by").alias(by)).agg(F.count("*").alias("n_messages"), (F.sum("n") + PROMPT).alias("n_tokens"))
