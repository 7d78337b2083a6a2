"""Token counts at every prefix of a text by prefix dynamic programming: see :class:`.bpe.WordBpe`.

The stored counts answer truncation and budget questions as plain column expressions, without the text or its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import portions
from .bpe import WordBpe
from .common import arrow_rows, texts

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long"


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


def tokens_before(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first chars characters (all, where there are fewer), from the stored counts."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens))
    return F.when(n > 0, F.get(prefix_tokens, n.cast("int") - 1)).otherwise(0)


def chars_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most budget tokens, from the stored counts."""
    from_end = F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= budget)), True)
    return F.when(from_end > 0, F.size(prefix_tokens) - from_end + 1).otherwise(0)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """For every row of docs(doc_id, text, ...): n_bytes, n_tokens, over_limit, bytes_in_limit and, if asked, prefix_tokens.

    tokenizer is the path of a word BPE file, the same on all machines. n_tokens is what the file's library gives for the
    whole text without added tokens; bytes_in_limit are the UTF-8 bytes of the longest prefix, in whole characters, that ends
    before or in the first stretch without white space that goes over limit tokens; prefix_tokens has the count at every
    prefix, by characters, for tokens_before and chars_within. Null and empty texts have no tokens; repeated rows are counted
    each; texts are never cut; an empty table gives an empty result; other columns are ignored.

    A worker holds the counts of up to 250,000 different stretches and words of at most 32 characters each. Where characters join when they are
    normalised, a stretch's table takes time with the square of its length; n_tokens never does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer)
        for batch in batches:
            for part, _, at in portions(batch):
                size, total, fits, each = (at[1:] - at[:-1]).tolist(), [], [], []
                for text, n in zip(part.column(1).to_pylist(), size, strict=True):
                    mine = bpe.steps(text)
                    total.append(sum(mine))
                    fits.append(len(text[: bpe.longest_prefix(text, mine, limit)].encode()) if total[-1] > limit else n)
                    if prefixes:
                        each.append(bpe.prefixes(text))
                cols = [part.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([t > limit for t in total], pa.bool_()), pa.array(fits, pa.int64())]
                names = [x.split()[0] for x in RESULT.split(", ")]
                if prefixes:
                    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each), pa.int32())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    arrow_rows(docs.sparkSession)
    return texts(docs).mapInArrow(run, RESULT + ", prefix_tokens array<int>" * prefixes)
