"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where public tokenizers lie; CHRONOPANEL_TOKENIZER overrides it.
TOKENIZER = os.environ.get("CHRONOPANEL_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def _counter(path: str):  # noqa: ANN202
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns in `keep` and `tokens`, the length of the whole text in tokens.

    tokenizer: path of a sentencepiece .model or a tokenizers .json file, the
    same on every executor. A null or empty text has 0 tokens.
    """
    types = dict(df.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in it:
            if count is None:
                count = _counter(tokenizer)
            n: list[int] = []
            col = b.column("_text")
            for at in range(0, b.num_rows, 256):  # bounds what is in memory beside the batch
                n += count([x or "" for x in col.slice(at, 256).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    rows = df.select(*[df[k] for k in keep], df[text].cast("string").alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", tokens long")
