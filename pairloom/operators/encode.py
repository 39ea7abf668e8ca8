"""User-supplied encoders, called in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import written


def embed_batches(
    df: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], batch_size: int = 64, text: str = "text", width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows (id, features) that were encoded, rows (id, error) that were not).

    A batch that fails, or gives another number of vectors or vectors of different widths, is tried row
    by row.  The encoder is called once for each batch that is well: what it gives is written, and both
    results read that.  With ``width`` every vector must have that width; without it vectors of an encoder whose
    width changes from batch to batch are not told apart.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, not {batch_size}")

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = [[float(x) for x in v] for v in encode(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            widths = {len(v) for v in vectors}
            if len(widths) > 1 or widths != {width or len(vectors[0])}:
                raise ValueError(f"vectors of width {', '.join(map(str, sorted(widths)))}" + (f" instead of {width}" if width else ""))
            return [(v, None) for v in vectors]
        except Exception as e:  # noqa: BLE001  what an encoder raises is unknown
            return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [t for x in texts for t in tried([x])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch_size):
                part = frame.iloc[k : k + batch_size]
                found = tried(part["text"].tolist())
                yield pd.DataFrame({"id": part["id"], "features": [v for v, _ in found], "error": [e for _, e in found]})

    rows = df.select("id", F.col(text).alias("text")).mapInPandas(run, f"id {dict(df.dtypes)['id']}, features array<double>, error string")
    rows = written(rows, "encoded")
    return rows.where("error is null").drop("error"), rows.where("error is not null").drop("features")


def failure_report(encoded: DataFrame, failed: DataFrame, examples: int = 5) -> tuple[int, list[str]]:
    """(number of failed rows, the first messages by id); raises if every row failed."""
    n = failed.count()
    messages = [r["error"] for r in failed.orderBy("id").limit(examples).collect()]
    if n and encoded.isEmpty():
        raise ValueError(f"no row could be encoded: {messages}")
    return n, messages


def embed_sequences(df: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[Sequence[float]]]], batch_size: int = 4, seq: str = "seq") -> DataFrame:
    """(id, residues): a vector for each position; another number of vectors than letters is an error."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, not {batch_size}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch_size):
                part = frame.iloc[k : k + batch_size]
                texts = part["seq"].tolist()
                found = [[[float(x) for x in v] for v in m] for m in encode(texts)]
                for t, m in zip(texts, found, strict=True):
                    if len(m) != len(t):
                        raise ValueError(f"{len(m)} vectors for {len(t)} letters")
                yield pd.DataFrame({"id": part["id"], "residues": found})

    return df.select("id", F.col(seq).alias("seq")).mapInPandas(run, f"id {dict(df.dtypes)['id']}, residues array<array<double>>")
