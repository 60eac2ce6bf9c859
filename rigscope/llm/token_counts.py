"""Operator 1: token counts of whole texts, lengths only.

Arrow batches are cut into slices of about equal bytes (a batch of long texts is worked off in many slices, a
batch of short ones in few), texts are split at boundaries that the tokenizer never joins across (see
``tokens``), and only the lengths come back: no ids cross the Arrow border.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each give their own row; any
further columns, whatever their names, are ignored unless named in ``keep``; an empty table gives no rows.
Strings of special tokens inside a text count as the library counts them by default (one token).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm import tokens as tk

UNITS = {"led": tk.led_units, "spaced": tk.spaced_units}


@lru_cache(maxsize=2)
def _encoder(path: str, units: str) -> tk.Encoder:
    return tk.Encoder(path, UNITS[units], ids=False, lower=units == "spaced")


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), units: str = "led") -> DataFrame:
    """``keep`` columns, n_bytes and n_tokens of each row. ``units``: "led" for byte-level tokenizers, "spaced" for those that drop white space."""
    kinds = dict(docs.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_bytes bigint", "n_tokens bigint"])

    def count(batches):
        encoder = _encoder(tokenizer, units)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offs = tn.buffer_of(texts)
            totals = [encoder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[0] for a, b in tn.slices(offs)]
            n_tokens = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offs)), pa.array(n_tokens)], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(count, out)


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
