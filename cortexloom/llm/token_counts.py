"""Token counts by a compiled finite-state tokenizer.

The piece model becomes a deterministic transducer (piece_automaton): each transition carries the
number of tokens it adds, chunks of the texts run side by side, and a prefix scan composes their
state maps, so a text of any length is counted without building its tokens.  One map over the
documents; no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids_and_texts, mapped, slices
from .piece_automaton import automaton_for, count, load_model

SLICE_BYTES = 512 << 10


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of docs.

    Counts are the library's without begin or end tokens.  A null text counts as empty: 0 bytes, 0
    tokens.  Repeated rows are counted each; columns besides id and text are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        automaton = automaton_for(model.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                n = count(automaton, texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.asarray(n) > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return mapped(ids_and_texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
