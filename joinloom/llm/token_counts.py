"""Token counts of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinloom.llm import arrays, bpe


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs`` (doc_id, text).

    vocabulary: path of the JSON file, present on every machine.  n_bytes is the
    UTF-8 length, n_tokens what the ``tokenizers`` library gives for the whole text
    without added tokens; special strings in a text are one token each.  A null
    text is empty: 0 and 0.  A null doc_id stays null; repeated rows are counted
    each; other columns are not read; an empty table gives an empty one.  A text is
    counted whole; a very long one is one row of a task.
    """

    def run(batches):
        vocab = bpe.load(vocabulary)
        for b in arrays.slices(batches):
            texts = arrays.texts(b.column("text"))
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            counts = [vocab.count(texts[s]) for s in bpe.chunks(texts)]
            n = np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
