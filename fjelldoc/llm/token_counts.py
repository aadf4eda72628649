"""Token counts of whole texts (operator 3).

An Arrow function returns lengths only. Each Arrow batch is cut into parts of bounded bytes, long texts
are split where no token can cross, and the parts are encoded in batches of equal bytes.

Defined cases: a null text counts as empty and has no tokens; rows are kept as they are, repeated ones
too; a text without a safe boundary is encoded whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fjelldoc.llm.common import bounded_batches, slices, utf8


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def lengths(batches):
        import pyarrow as pa

        from fjelldoc.llm.tokens import PieceCounts, loaded

        counts = loaded(PieceCounts, model_path)
        for batch in batches:
            for part in slices(batch, text):
                texts = utf8(part.column(text))
                n = counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    [key, "n_bytes", "n_tokens", "over_limit"],
                )

    return rows.mapInArrow(lengths, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
