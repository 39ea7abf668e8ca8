"""Ranked lexical search by a threshold-seeded join.

Texts are cut to the terms that the queries (items) use.  Each term's k best impacts are stored, with
their documents: k documents hold a term with its kth impact or more, so the weighted kth impact bounds
an item's kth score from below, and the exact scores of the stored documents of its rarest terms bound it
closer.  An item's terms are ordered by the most that they can add; those whose suffix of the order can't
reach the bound are pruned.  What the others' postings meet are candidates; candidates that still can
reach the bound are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import ALNUM, Words, quoted, text_slices, written
from pairloom.llm.decontamination import FILTER_BITS, _filter

#: Documents that each item gets.
TOP = 10
#: Terms of an item whose stored documents are scored to bound its kth score.
SEED_TERMS = 8
#: Terms of items that are sent to the workers at once (24 MB); more are matched in blocks.
BLOCK_TERMS = 1_000_000
#: Pairs that a task looks at together.
PAIRS = 1 << 20
#: Stored impacts, or scores, that a task holds before it hands them on or drops the lowest.
HELD = 1 << 20


def _counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in their order, hashes as signed numbers, with counts."""
    signed = hashes.view(np.int64)
    order = np.lexsort((signed, rows))
    rows, signed = rows[order], signed[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (signed[1:] != signed[:-1])])) if len(rows) else np.zeros(0, int)
    return rows[first], signed[first], np.diff(np.append(first, len(rows)))


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term, repeats): the terms of each row of ``items``, which ``item`` numbers; written once."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), quoted(item).alias("item_id"), quoted(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, flat, at in text_slices(batch["text"]):
                words = Words(flat, at, ALNUM)
                rows, terms, counts = _counted(words.row, words.hash)
                own = pa.array(rows + row)
                yield pa.RecordBatch.from_arrays([batch["item"].take(own), batch["item_id"].take(own), pa.array(terms), pa.array(counts.astype(np.int64))], ["item", "item_id", "term", "repeats"])

    return written(rows.mapInArrow(cut, f"item long, item_id {dict(rows.dtypes)['item_id']}, term long, repeats long"), "item_terms")


def forward_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, counts) of each document: its length in terms, and those that items may use.

    Terms pass a filter of fixed size, so some others pass as well; they meet no item.  Written once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter(terms.select(F.col("term").alias("gram"))))  # 8 MB
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(key).alias("doc_id"), quoted(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for row, end, flat, at in text_slices(batch["text"]):
                words = Words(flat, at, ALNUM)
                place = words.hash & np.uint64(FILTER_BITS - 1)
                near = (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                rows, terms, counts = _counted(words.row[near], words.hash[near])
                offsets = pa.array(np.searchsorted(rows, np.arange(end - row + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms, counts.astype(np.int64))]
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([own["row"], own["doc_id"], pa.array(words.counts.astype(np.int64)), *lists], ["row", "doc_id", "n", "terms", "counts"])

    return written(rows.mapInArrow(cut, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n long, terms array<long>, counts array<long>"), "forward")


def _impacts(n: np.ndarray, tf: np.ndarray, N: int, L: int) -> np.ndarray:
    """The impact of a term that a document of n terms holds tf times."""
    if len(n) and 75 * int(n.max()) * N >= 1 << 63:
        n = n.astype(object)  # whole numbers of any size
    m = 25 + (75 * n * N // L).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def impact(n: Column, tf: Column, N: int, L: int) -> Column:
    """The same of columns."""
    share = (F.lit(75) * n).cast("decimal(20,0)") * F.lit(N).cast("decimal(18,0)")
    m = F.lit(25) + F.call_function("div", share, F.lit(L).cast("decimal(20,0)"))
    return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


class _Postings:
    """The postings of a batch of the forward index: document, term, impact; sorted by document and term."""

    def __init__(self, batch: pa.RecordBatch, N: int, L: int):
        terms, counts = (batch[c] for c in ("terms", "counts"))
        self.doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
        self.term = terms.flatten().to_numpy()
        self.impact = _impacts(batch["n"].to_numpy()[self.doc], counts.flatten().to_numpy(), N, L)


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k rows of each run of equal groups."""
    if not len(group):
        return np.zeros(0, int)
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
    return np.flatnonzero(np.arange(len(group)) - first < k)


def best_impacts(forward: DataFrame, N: int, L: int, k: int) -> DataFrame:
    """(term, held, impacts, rows): for each task and term, how many of its documents hold the term, and its k best; written once."""

    def emit(terms, counts, best) -> pa.RecordBatch:
        at = pa.array(np.searchsorted(best[0], np.append(terms, np.iinfo(np.int64).max), "left").astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in best[1:]]
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts), *lists], ["term", "held", "impacts", "rows"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        terms, counts, best = none, none, (none, none, none)
        for batch in batches:
            if not len(batch):
                continue
            own = _Postings(batch, N, L)
            both, inverse = np.unique(np.concatenate([terms, own.term]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(own.term), np.int64)]), len(both)).astype(np.int64)
            least = np.full(len(both), -1, np.int64)  # the kth impact so far
            full = _first(best[0], k)
            last = full[np.append(best[0][full][1:] != best[0][full][:-1], True)] if len(full) else full
            kth = last[np.bincount(np.searchsorted(both, best[0]), minlength=len(both))[np.searchsorted(both, best[0][last])] >= k]
            least[np.searchsorted(both, best[0][kth])] = best[1][kth]
            some = own.impact > least[inverse[len(terms) :]]
            rows = batch["row"].to_numpy()[own.doc[some]]
            joined = tuple(np.concatenate(x) for x in zip(best, (own.term[some], own.impact[some], rows), strict=True))
            order = np.lexsort((joined[2], -joined[1], joined[0]))
            order = order[_first(joined[0][order], k)]
            terms, best = both, tuple(x[order] for x in joined)
            if len(best[0]) > HELD:
                yield emit(terms, counts, best)
                terms, counts, best = none, none, (none, none, none)
        yield emit(terms, counts, best)

    return written(forward.mapInArrow(collect, "term long, held long, impacts array<long>, rows array<long>"), "best")


def _bounded(forward: DataFrame, terms: DataFrame, N: int, L: int, k: int, seed_terms: int) -> DataFrame:
    """(item, term, weight, most, rest, bound): an item's terms in the order of the most that they can add.

    ``weight`` has the repeats in it, ``rest`` is the sum of ``most`` from this term on, ``bound`` what an
    item's kth score reaches at least.
    """
    partial = best_impacts(forward, N, L, k)
    w = F.floor(1000 * F.log((F.lit(2 * N + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    df = partial.groupBy("term").agg(F.sum("held").alias("df"))
    pairs = partial.select("term", F.explode(F.arrays_zip("impacts", "rows")).alias("p")).select("term", "p.impacts", "p.rows")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impacts"), "rows"))
    stored = pairs.withColumn("place", place).where(F.col("place") <= k)
    stored = stored.groupBy("term").agg(F.max("impacts").alias("top"), F.min(F.when(F.col("place") == k, F.col("impacts"))).alias("kth"), F.collect_list("rows").alias("rows"))  # k rows at most
    stats = stored.join(df, "term").select("term", w.alias("w"), "top", F.coalesce("kth", F.lit(0)).alias("kth"), "rows")
    weight = F.col("repeats") * F.col("w")
    known = terms.join(stats, "term").where("w > 0").select("item", "term", weight.alias("weight"), (weight * F.col("top")).alias("most"), (weight * F.col("kth")).alias("kth"), "rows", "w")
    known = written(known, "known")
    rare = known.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("w"), "term"))).where(F.col("place") <= seed_terms)
    seeds = rare.select("item", F.explode("rows").alias("row")).distinct()
    held = seeds.join(forward.select("row", "n", "terms", "counts"), "row").select("item", "row", "n", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    held = held.select("item", "row", F.col("p.terms").alias("term"), impact(F.col("n"), F.col("p.counts"), N, L).alias("impact"))
    scores = held.join(known.select("item", "term", "weight"), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    kth = scores.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == k)
    single = known.groupBy("item").agg(F.max("kth").alias("single"))
    bound = single.join(kth, "item", "left").select("item", F.greatest("single", F.coalesce("score", F.lit(0))).alias("bound"))
    falling = Window.partitionBy("item").orderBy(F.desc("most"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return written(known.withColumn("rest", F.sum("most").over(falling)).join(bound, "item").select("item", "term", "weight", "most", "rest", "bound"), "bounded")


def _lists(owner: np.ndarray, owners: int) -> np.ndarray:
    """Offsets of the runs of a sorted column of numbers from 0."""
    return np.searchsorted(owner, np.arange(owners + 1))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each run, one behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)


class _Items:
    """A block of items: which of them a term makes candidates, and what the other terms add."""

    def __init__(self, table: pa.Table):
        self.items, item = np.unique(table["item"].to_numpy(), return_inverse=True)
        self.terms, term = np.unique(table["term"].to_numpy(), return_inverse=True)
        weight, rest, bound = (table[c].to_numpy() for c in ("weight", "rest", "bound"))
        self.bound = np.zeros(len(self.items), np.int64)
        self.bound[item] = bound
        keep = rest >= bound
        self.rest = np.zeros(len(self.items), np.int64)  # the most that the pruned terms add together
        np.maximum.at(self.rest, item[~keep], rest[~keep])
        order = np.lexsort((item[keep], term[keep]))
        self.by_term = _lists(term[keep][order], len(self.terms)), item[keep][order], weight[keep][order]
        order = np.lexsort((term[~keep], item[~keep]))
        self.by_item = _lists(item[~keep][order], len(self.items)), term[~keep][order], weight[~keep][order]

    def scored(self, own: _Postings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, score) of all that reach their item's bound."""
        at = np.searchsorted(self.terms, own.term)
        known = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == own.term)
        doc, term, impact = own.doc[known], at[known], own.impact[known]
        key = doc * len(self.terms) + term  # rises: terms are sorted in each document
        offsets, items, weights = self.by_term
        pairs = np.cumsum(offsets[term + 1] - offsets[term])
        first = 0
        while first < len(doc):  # whole documents, as many as make so many pairs
            end = np.searchsorted(pairs, (pairs[first - 1] if first else 0) + PAIRS, "right")
            end = np.searchsorted(doc, doc[min(max(end, first + 1), len(doc)) - 1], "right") if end < len(doc) else len(doc)
            run = slice(first, end)
            first = end
            size = offsets[term[run] + 1] - offsets[term[run]]
            place = _spread(offsets[term[run]], size)
            pair = np.repeat(doc[run], size) * len(self.items) + items[place]
            added = np.repeat(impact[run], size) * weights[place]
            order = np.argsort(pair, kind="stable")
            pair, added = pair[order], added[order]
            begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
            score = np.add.reduceat(added, begins) if len(begins) else np.zeros(0, np.int64)
            d, i = np.divmod(pair[begins], len(self.items))
            able = score + self.rest[i] >= self.bound[i]
            yield self._whole(d[able], i[able], score[able], key, impact)

    def _whole(self, doc: np.ndarray, item: np.ndarray, score: np.ndarray, key: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact scores: with what the pruned terms add."""
        offsets, terms, weights = self.by_item
        sizes = offsets[item + 1] - offsets[item]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, sizes.sum() + 1, PAIRS)) if len(sizes) else []
        for some in np.split(np.arange(len(doc)), np.unique(cuts)) if len(doc) else ():
            size = sizes[some]
            place = _spread(offsets[item[some]], size)
            want = np.repeat(doc[some], size) * len(self.terms) + terms[place]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            added = np.where(key[at] == want, impact[at] * weights[place], 0)
            sums = np.concatenate([[0], np.cumsum(added)])
            ends = np.cumsum(size)
            score[some] += sums[ends] - sums[ends - size]
        good = (score > 0) & (score >= self.bound[item])
        return doc[good], item[good], score[good]


def _matched(forward: DataFrame, items: _Items, N: int, L: int, k: int) -> DataFrame:
    """(item, doc_id, row, score): the k best of each item in each task."""
    shared = forward.sparkSession.sparkContext.broadcast(items)  # a block of BLOCK_TERMS, or one item

    def top(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        return table.take(pa.array(_first(table["item"].to_numpy(), k)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, []
        for batch in batches:
            if not len(batch):
                continue
            for doc, item, score in own.scored(_Postings(batch, N, L)):
                at = pa.array(doc)
                held.append(pa.table({"item": own.items[item], "doc_id": batch["doc_id"].take(at), "row": batch["row"].take(at), "score": score}))
            if sum(map(len, held)) > HELD:
                held = [top(held)]
        if held:
            yield from top(held).to_batches()

    return forward.mapInArrow(match, f"item long, doc_id {dict(forward.dtypes)['doc_id']}, row long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed_terms: int = SEED_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest score above 0, from rank 1.

    Terms are runs of digits, letters and all beyond ASCII, A-Z lowered, told apart by 64-bit hashes.
    Equal scores rank by ascending doc_id, null last, then by the row.  Each row of ``items`` is an item,
    whatever its id; items and documents without a term, null texts among them, find and are found
    nowhere; texts are read whole, however long; repeated documents rank each; other columns are not
    looked at.  The bounds only prune what can't be among the k best, ties included.
    """
    terms = item_terms(items, item, item_text)
    forward = forward_index(docs, terms, key, text)
    N, L = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = dict(terms.dtypes)["item_id"]
    if not N:
        return docs.sparkSession.createDataFrame([], f"item_id {ids}, rank int, doc_id {dict(forward.dtypes)['doc_id']}, score long")
    bounded = _bounded(forward, terms, N, L, k, seed_terms)
    blocks = 1 + bounded.count() // block_terms
    found = []
    for b in range(blocks):
        table = bounded.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        if len(table):
            found.append(_matched(forward, _Items(table), N, L, k))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {ids}, rank int, doc_id {dict(forward.dtypes)['doc_id']}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = terms.select("item", "item_id").distinct()
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
