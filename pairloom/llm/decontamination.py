"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are compared with A-Z lowered.  A benchmark item is cut into all windows of ``n`` following
words (an item with fewer words is one window).  Training texts are scanned window by window against
a hash set of those windows; each hit is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ALNUM, Words, as_batch, quoted, text_slices, written

#: Words of a window.
WINDOW = 10
#: Most bytes of distinct windows, with their hashes and items, that are broadcast; with more, windows are joined.
BROADCAST_BYTES = 64 << 20

SCAN = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _own_grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of ``size`` words of one text begins, and its hash."""
    grams = words.grams(size)
    first = np.flatnonzero(words.row[: len(grams)] == words.row[size - 1 :]) if len(grams) else np.zeros(0, int)
    return first, grams[first]


def _key(words: Words, first: int, size: int) -> bytes:
    low = words.low
    return b" ".join(low[words.start[k] : words.end[k]].tobytes() for k in range(first, first + size))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(size, gram, words, items) of each distinct window; items are the ids of those that hold it, without null.

    Items without a text or word have no window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, _, flat, at in text_slices(batch.column(1)):
                words = Words(flat, at, ALNUM)
                out = []
                for size in {min(window, int(n)) for n in words.counts if n}:
                    for k, gram in zip(*_own_grams(words, size), strict=True):
                        if min(window, words.counts[words.row[k]]) == size:
                            out.append((ids[row + words.row[k]], size, int(gram.view(np.int64)), _key(words, k, size)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds, names = (pa.string(), pa.int32(), pa.int64(), pa.binary()), ["item", "size", "gram", "words"]
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    found = rows.mapInArrow(cut, "item string, size int, gram long, words binary")
    return found.groupBy("size", "gram", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class _Index:
    """Windows by their hash, with the words that verify a hit, in flat arrays; sent to each worker once."""

    def __init__(self, windows: pa.Table):
        """``windows``: size, gram, words and items of each window, sorted by size and gram."""
        sizes, grams = windows["size"].to_numpy(), windows["gram"].to_numpy().view(np.uint64)
        self.words, self.items = windows["words"].combine_chunks(), windows["items"].combine_chunks()
        self.parts = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(grams[own], kind="stable")]
            places = 1 << max(10, min(24, int(16 * len(own)).bit_length()))
            near = np.zeros(places, bool)
            near[grams[own] & np.uint64(places - 1)] = True
            self.parts[size] = (own, grams[own], near)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each window that occurs."""
        for size, (own, known, filtered) in self.parts.items():
            first, grams = _own_grams(words, size)
            near = np.flatnonzero(filtered[grams & np.uint64(len(filtered) - 1)])
            low, high = np.searchsorted(known, grams[near], "left"), np.searchsorted(known, grams[near], "right")
            for k, a, b in zip(first[near].tolist(), low.tolist(), high.tolist(), strict=True):
                key = _key(words, k, size) if a < b else b""
                for j in own[a:b].tolist():
                    if self.words[j].as_py() == key:
                        yield k, size, self.items[j].as_py()


def _report(words: Words, flat: np.ndarray, at: np.ndarray, hits: list[tuple[int, int, list[str]]], clean: bool) -> dict[str, pa.Array]:
    """The columns of SCAN for a run of texts, and the clean text if that is asked for."""
    step = np.zeros(len(words.start) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for k, size, found in hits:
        step[k] += 1
        step[k + size] -= 1
        items.setdefault(int(words.row[k]), set()).update(found)
    hit = np.cumsum(step)[:-1] > 0
    n_hit = np.bincount(words.row[hit], minlength=len(at) - 1)
    names = [sorted(items.get(i, ())) for i in range(len(at) - 1)]
    out = {
        "n_words": pa.array(words.counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in names], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
        "contaminated": pa.array(n_hit > 0),
    }
    if clean:
        texts = [_without(words, flat, at, hit, i) if n_hit[i] else flat[at[i] : at[i + 1]].tobytes().decode() for i in range(len(at) - 1)]
        out["clean_text"] = pa.array(texts, pa.string())
    return out


def _without(words: Words, flat: np.ndarray, at: np.ndarray, hit: np.ndarray, row: int) -> str:
    """A text without its runs of hit words."""
    lo, hi = np.searchsorted(words.row, [row, row + 1])
    own = np.flatnonzero(hit[lo:hi]) + lo
    runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
    pieces, begin = [], at[row]
    for run in runs:
        pieces.append(flat[begin : words.start[run[0]]].tobytes())
        begin = words.end[run[-1]]
    return b"".join([*pieces, flat[begin : at[row + 1]].tobytes()]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    keep: list[str] | None = None,
    clean: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``keep`` columns (default: doc_id) and the columns of SCAN, one row for each document.

    ``n_hit`` counts words inside any window that occurs, ``items_sha256`` digests the sorted ids of
    the items with such windows; with ``clean`` there is ``clean_text``, the text without the hit words.
    A null or empty text has no words; an item without an id hits like others and counts in no
    ``n_items``; repeated rows are reported each; an empty benchmark hits nothing.  A column of SCAN
    whose name is among ``keep`` gets the prefix ``scan_``.
    Windows of at most ``broadcast_bytes`` in all are broadcast; a larger benchmark is joined with
    the documents' windows by hash, which gives the same rows.
    """
    keep = keep or ["doc_id"]
    windows = written(benchmark_windows(benchmark, window), "windows")
    held = F.octet_length("words") + 48 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    if (windows.agg(F.sum(held)).first()[0] or 0) > broadcast_bytes:
        return _by_join(docs, windows, text, keep, clean)
    index = docs.sparkSession.sparkContext.broadcast(_Index(windows.toArrow()))  # its size was checked

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, flat, at in text_slices(batch.column(len(keep))):
                words = Words(flat, at, ALNUM)
                columns = _report(words, flat, at, list(index.value.hits(words)), clean)
                yield as_batch(batch.slice(row, end - row), [f"k{i}" for i in range(len(keep))], **columns)

    return _mapped(docs, text, keep, scan, SCAN + ", clean_text string" * clean)


def _mapped(docs: DataFrame, text: str, keep: list[str], step, schema: str) -> DataFrame:
    """mapInArrow over the kept columns and the text, under names that can't clash."""
    return _named(docs.select(*_kept(keep), quoted(text).alias("__text")), keep, step, schema)


def _kept(keep: list[str]) -> list[Column]:
    return [quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]


def _named(rows: DataFrame, keep: list[str], step, schema: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(step, ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))), schema]))
    more = out.columns[len(keep) :]
    return out.toDF(*keep, *[f"scan_{c}" if c in keep else c for c in more])


#: Bits of the filter that the windows of texts pass before they are shuffled (8 MB).
FILTER_BITS = 1 << 26


def _filter(windows: DataFrame) -> np.ndarray:
    """One bit for each hash of a window, in 64-bit words; at most FILTER_BITS / 64 rows reach the driver."""
    place = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = windows.select(F.shiftrightunsigned(place, 6).alias("at"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _by_join(docs: DataFrame, windows: DataFrame, text: str, keep: list[str], clean: bool) -> DataFrame:
    """The same for a benchmark that is too large to broadcast: windows meet by a shuffle on their words.

    Only windows that pass a filter of hashes are shuffled, those of copies once: rows meet their hits
    again by the digest of their text.
    """
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``window`` numbers
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for row, _, flat, at in text_slices(batch.column(1), 1 << 20):
                words = Words(flat, at, ALNUM)
                base = np.concatenate([[0], np.cumsum(words.counts)])
                for size in sizes:
                    first, grams = _own_grams(words, size)
                    place = grams & np.uint64(FILTER_BITS - 1)
                    near = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    first, whose = first[near], words.row[first[near]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + whose)),
                            pa.array(np.full(len(first), size, np.int32)),
                            pa.array(first - base[whose], pa.int64()),
                            pa.array(grams[near].view(np.int64)),
                            pa.array([_key(words, k, size) for k in first], pa.binary()),
                        ],
                        ["sha", "size", "first", "gram", "words"],
                    )

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(keep) + 1).to_pylist()
            for row, end, flat, at in text_slices(batch.column(len(keep))):
                words = Words(flat, at, ALNUM)
                base = np.concatenate([[0], np.cumsum(words.counts)])
                hits = [(int(base[i]) + h["first"], h["size"], h["items"]) for i in range(end - row) for h in found[row + i] or ()]
                columns = _report(words, flat, at, hits, clean)
                yield as_batch(batch.slice(row, end - row), [f"k{i}" for i in range(len(keep))], **columns)

    own = F.coalesce(quoted(text), F.lit(""))
    sha = F.sha2(own, 256)
    near = docs.select(sha.alias("sha"), own.alias("text")).mapInArrow(cut, "sha string, size int, first long, gram long, words binary").distinct()
    hits = near.join(windows, ["size", "gram", "words"]).groupBy("sha").agg(F.collect_list(F.struct("first", "size", "items")).alias("hits"))
    rows = docs.select(*_kept(keep), quoted(text).alias("__text"), sha.alias("sha")).join(hits, "sha", "left").drop("sha")
    return _named(rows, keep, report, SCAN + ", clean_text string" * clean)
