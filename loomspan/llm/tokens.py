"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Byte-level BPE of 50 256 tokens; its place on every machine is a parameter of all functions here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SENTENCE = re.compile(r"[^.!?…]*[.!?…]+(?=\s+\S)")


def load_encoding(path: str):
    """The tokenizer at ``path`` (ranks as base64 and number in lines), kept by each worker process."""
    import base64

    import public_tokenizers
    import tiktoken

    kept = sys.__dict__.setdefault("_loomspan_encodings", {})
    if path not in kept:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_sizes(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens and loss_tokens of every text.

    loss_tokens are those behind the text's prompt: its first line, or the first
    sentence of a text of one line; a text of one sentence has no prompt.  A null
    or empty text has 0 tokens.  Texts are tokenised whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(path).encode_ordinary
        for batch in batches:
            sizes, losses = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                head, cut, _ = text.partition("\n")
                if not cut:
                    sentence = _SENTENCE.match(text)
                    head = sentence[0] if sentence else ""
                sizes.append(len(encode(text)))
                losses.append(sizes[-1] - len(encode(head)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), pa.array(losses, pa.int64())], names=["doc_id", "source", "tokens", "loss_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, tokens long, loss_tokens long")
