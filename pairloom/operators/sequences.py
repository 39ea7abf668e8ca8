"""Texts and sequences of entities: cleaning and features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import discard, saved, shared_path, short_shuffles, written

# Amino acids in the order of the composition, letters of a clean sequence, classes of letters.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
CLEAN = "ACDEFGHIKLMNPQRSTVWYX"
BLANKS = r"\x09-\x0D\x1C-\x20\x85\p{Z}"  # in a class of a regular expression
CLASSES = {"aromatic": "FWYH", "polar": "STNQC", "positive": "KRH", "negative": "DE", "aliphatic": "AVILM", "gly_pro": "GP", "cysteine": "C"}


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def first_non_empty(df: DataFrame, id: str, text: str, order: str, trim: bool = True, drop_empty: bool = True) -> DataFrame:
    """(id, text): the first text of each id by ``order``.

    With ``trim`` blank texts don't count and the text is trimmed; ids without any text are dropped, or
    have an empty one.  A null text is an empty one.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    value = stripped(value) if trim else value
    best = df.groupBy(F.col(id).alias("id")).agg(F.min_by(value, F.when(value != "", F.col(order))).alias("text"))
    best = best.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return best.where("text <> ''") if drop_empty else best


def head_entities(df: DataFrame, n: int, id: str = "id") -> DataFrame:
    """The first n entities in the order of their ids."""
    return df.orderBy(id).limit(n)


def clean_sequence(seq: Column) -> Column:
    """Letters outside ASCII and blanks away, upper case, then only the letters of sequences."""
    letters = F.regexp_replace(F.coalesce(seq, F.lit("")), "[^A-Za-z]", "")
    return F.regexp_replace(F.upper(letters), f"[^{CLEAN}]", "")


def clean_sequences(df: DataFrame, min_len: int = 1, seq: str = "seq") -> DataFrame:
    """The rows with clean sequences of at least ``min_len`` letters."""
    if min_len < 1:
        raise ValueError(f"min_len must be at least 1, not {min_len}")
    return df.withColumn(seq, clean_sequence(F.col(seq))).where(F.length(seq) >= min_len)


def dropped_count(df: DataFrame, min_len: int = 1, seq: str = "seq") -> DataFrame:
    """(total, dropped) of cleaning."""
    short = F.length(clean_sequence(F.col(seq))) < min_len
    return df.agg(F.count("*").alias("total"), F.count_if(short).alias("dropped"))


def _of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def composition(seq: Column) -> Column:
    """20 fractions of the valid letters; zeros if there is none."""
    total = _of(seq, AMINO_ACIDS)
    return F.array(*[F.coalesce(_of(seq, a) / F.nullif(total, F.lit(0)), F.lit(0.0)) for a in AMINO_ACIDS])


def physico_chemical(seq: Column) -> Column:
    """Length, and the fractions of letters in seven classes; zeros for an empty sequence."""
    n = F.length(seq)
    return F.array(n.cast("double"), *[F.coalesce(_of(seq, c) / F.nullif(n, F.lit(0)), F.lit(0.0)) for c in CLASSES.values()])


def dipeptide_vectors(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """(id, features): the 400 fractions of the overlapping pairs of valid letters of each row, zeros if there is no pair.

    Pairs are counted where the sequence is; nothing is shuffled.
    """
    places = np.full(128, -1)
    places[[ord(a) for a in AMINO_ACIDS]] = range(len(AMINO_ACIDS))
    size = len(AMINO_ACIDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                out = np.zeros((len(part), size * size))
                for i, t in enumerate(part.column(1)):
                    x = places[np.frombuffer((t.as_py() or "").encode(), np.uint8)]
                    if len(x) > 1:
                        out[i] = np.bincount(size * x[:-1] + x[1:], minlength=size * size) / (len(x) - 1)
                at = pa.array((np.arange(len(part) + 1) * size * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], ["id", "features"])

    rows = df.select(F.col(id).alias("id"), F.regexp_replace(seq, f"[^{AMINO_ACIDS}]", "").alias("s"))
    return rows.mapInArrow(count, f"id {dict(rows.dtypes)['id']}, features array<double>")


def sequence_vectors(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """(id, features): composition, pairs of letters and properties of the amino acids of each row, 428 places, in one pass."""
    places = np.full(128, -1)
    places[[ord(a) for a in AMINO_ACIDS]] = range(len(AMINO_ACIDS))
    size = len(AMINO_ACIDS)
    classes = np.array([[a in c for c in CLASSES.values()] for a in AMINO_ACIDS], float)
    width = size + size * size + 1 + len(CLASSES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                out = np.zeros((len(part), width))
                for i, t in enumerate(part.column(1)):
                    x = places[np.frombuffer((t.as_py() or "").encode(), np.uint8)]
                    if len(x):
                        own = np.bincount(x, minlength=size)
                        out[i, :size] = own / len(x)
                        out[i, size + size * size] = len(x)
                        out[i, size + size * size + 1 :] = own @ classes / len(x)
                    if len(x) > 1:
                        out[i, size : size + size * size] = np.bincount(size * x[:-1] + x[1:], minlength=size * size) / (len(x) - 1)
                at = pa.array((np.arange(len(part) + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], ["id", "features"])

    rows = df.select(F.col(id).alias("id"), F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), f"[^{AMINO_ACIDS}]", "").alias("s"))
    return rows.mapInArrow(count, f"id {dict(rows.dtypes)['id']}, features array<double>")


def dipeptides(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """(id, pair, fraction) of the pairs that occur: the sparse long form."""
    names = F.array(*[F.lit(a + b) for a in AMINO_ACIDS for b in AMINO_ACIDS])
    long = dipeptide_vectors(df, id, seq).select("id", F.posexplode("features").alias("k", "fraction")).where("fraction > 0")
    return long.select("id", F.get(names, F.col("k")).alias("pair"), "fraction")


#: Grams whose weights are broadcast; with more, they are joined.
BROADCAST_GRAMS = 2_000_000
#: Bits of a code point.
POINT = 21


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(id, codes, counts) of the grams of three characters of each text (id, t); a code is the row of code points."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = [], []
            for t in batch.column(1):
                x = np.frombuffer((t.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                own, n = np.unique(x[:-2] << 2 * POINT | x[1:-1] << POINT | x[2:], return_counts=True) if len(x) > 2 else (x[:0], x[:0])
                codes.append(own)
                counts.append(n)
            at = pa.array(np.cumsum([0, *map(len, codes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(v).astype(np.int64))) for v in (codes, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "codes", "counts"])

    return rows.mapInArrow(count, f"id {dict(rows.dtypes)['id']}, codes array<long>, counts array<long>")


def _named_grams(often: DataFrame) -> DataFrame:
    """(code, gram, df)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_pylist()
            grams = [chr(c >> 2 * POINT) + chr(c >> POINT & (1 << POINT) - 1) + chr(c & (1 << POINT) - 1) for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.string()), batch.column(1)], ["code", "gram", "df"])

    return often.mapInArrow(name, "code long, gram string, df long")


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s\s+", " ")


def gram_vectors(df: DataFrame, id: str, text: str, few: Callable[[int], bool]) -> tuple[DataFrame | None, np.ndarray, int, int]:
    """((id, places, tf), weights of the places, rows, entries): the counts of grams of ``trigram_tfidf``, a row for each text.

    Places are those of the grams by falling numbers of texts.  None for the rows if ``few`` doesn't hold for the number of
    distinct grams.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "grams")
    counts = saved(_gram_counts(df.select(F.col(id).alias("id"), _spaced(F.col(text)).alias("t"))), path)
    with short_shuffles(spark):
        often = written(counts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")), "vocabulary")
    n, (grams, entries) = counts.count(), often.agg(F.count("*"), F.sum("df")).first()
    if not few(grams):
        discard(spark, path)
        return None, np.zeros(0), n, entries or 0
    table = often.toArrow().sort_by([("df", "descending"), ("code", "ascending")])
    codes, df_of = table["code"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast((codes[order], order.astype(np.int32)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, places = shared.value
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                place = places[np.searchsorted(codes, part["codes"].flatten().to_numpy())] if len(codes) else np.zeros(0, np.int32)
                at = pa.array(np.concatenate([[0], np.cumsum(part["codes"].value_lengths().to_numpy())]).astype(np.int32))
                tf = part["counts"].flatten().to_numpy().astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["id"], *(pa.ListArray.from_arrays(at, pa.array(v)) for v in (place, tf))], ["id", "places", "tf"])

    rows = written(counts.mapInArrow(placed, f"id {dict(counts.dtypes)['id']}, places array<int>, tf array<int>"), "vectors")
    discard(spark, path)
    return rows, np.log((1.0 + n) / (1 + df_of)) + 1, n, entries or 0


def trigram_tfidf(df: DataFrame, id: str = "id", text: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(id, gram, tf, df, weight): grams of three characters, raw counts times ln((1 + n) / (1 + df)) + 1, at length 1 for each id.

    Case is kept and runs of two or more white space characters become one space.  Ids are distinct.
    Grams are counted where their text is; only the table of distinct grams is shuffled, and broadcast
    if it has at most ``broadcast_grams`` rows.
    """
    counts = written(_gram_counts(df.select(F.col(id).alias("id"), _spaced(F.col(text)).alias("t"))), "grams")
    often = counts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    often, n = written(_named_grams(often), "vocabulary"), counts.count()
    if often.count() > broadcast_grams:
        return _joined_weights(counts, often, n)
    table = often.toArrow().sort_by("code")
    spark, kind = df.sparkSession, dict(counts.dtypes)["id"]
    shared = spark.sparkContext.broadcast((table["code"].to_numpy(), table["gram"].combine_chunks(), table["df"].to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, grams, often = shared.value
        idf = np.log((1.0 + n) / (1 + often)) + 1
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                place = np.searchsorted(codes, part.column(1).flatten().to_numpy())
                tf, size = part.column(2).flatten().to_numpy(), part.column(1).value_lengths().to_numpy()
                whose = np.repeat(np.arange(len(part)), size)
                w = tf * idf[place]
                w /= np.sqrt(np.bincount(whose, w * w, len(part)))[whose]
                cols = [part.column(0).take(pa.array(whose)), grams.take(pa.array(place)), pa.array(tf), pa.array(often[place]), pa.array(w)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "gram", "tf", "df", "weight"])

    return counts.mapInArrow(weigh, f"id {kind}, gram string, tf long, df long, weight double")


def _joined_weights(counts: DataFrame, often: DataFrame, n: int) -> DataFrame:
    long = counts.select("id", F.explode(F.arrays_zip("codes", "counts")).alias("c")).select("id", F.col("c.codes").alias("code"), F.col("c.counts").alias("tf"))
    idf = F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1
    raw = long.join(often, "code").select("id", "gram", "tf", "df", (F.col("tf") * idf).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "gram", "tf", "df", (F.col("w") / F.col("norm")).alias("weight"))


def joined_features(*groups: DataFrame) -> DataFrame:
    """(id, features): the vectors of all groups (id, features), one behind the other."""
    out = groups[0].select("id", F.col("features").alias("__0"))
    for k, g in enumerate(groups[1:], 1):
        out = out.join(g.select("id", F.col("features").alias(f"__{k}")), "id")
    return out.select("id", F.concat(*[f"__{k}" for k in range(len(groups))]).alias("features"))
