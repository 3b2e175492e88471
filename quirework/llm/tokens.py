"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the tokenizer's file lies on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters encoded at once.
CHUNK = 2_000_000


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text; a null text has none. Texts are encoded whole; strings of special tokens are ordinary text."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
        encoder.no_truncation()
        for texts in batches:
            sizes: list[int] = []
            some: list[str] = []
            held = 0
            for t in texts:
                if some and (len(some) >= 200 or held + len(t or "") > CHUNK):
                    sizes += [len(e.ids) for e in encoder.encode_batch_fast(some, add_special_tokens=False)]
                    some, held = [], 0
                some.append(t or "")
                held += len(t or "")
            if some:
                sizes += [len(e.ids) for e in encoder.encode_batch_fast(some, add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return count(text)
