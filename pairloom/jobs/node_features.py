"""Node features made from what is known of the entities: vectors of the left side, sequences of the right side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import sequences as S
from pairloom.operators.folds import dense_index
from pairloom.operators.reduce import safe_project, text_svd
from pairloom.session import written
from pairloom.sources.tables import stack_features


def sequence_features(sequences: DataFrame, tfidf_dim: int = 128) -> DataFrame:
    """(id, features) of rows (id, seq), one for each id: composition, pairs of letters, properties, decomposed weights of grams.

    Letters that are no amino acids count in the grams only.  The rows are read twice.  A null or empty sequence has zeros.  Ids are
    distinct and not null.  Without ``tfidf_dim`` there are 428 places.
    """
    own = S.sequence_vectors(sequences)
    return S.joined_features(own, text_svd(sequences, tfidf_dim, text="seq")) if tfidf_dim > 0 else own


def node_features(left: DataFrame, right: DataFrame, output_dim: int = 128, tfidf_dim: int = 128) -> DataFrame:
    """(node, side, id, features): every entity of both sides with ``output_dim`` places, left nodes first.

    ``left`` is (id, features), ``right`` is (id, seq).  Nodes of a side are numbered by their ids.  Each side is
    standardised and projected by itself.
    """
    sides = []
    for name, rows in (("left", left), ("right", sequence_features(right, tfidf_dim))):
        made = written(safe_project(written(rows.select("id", "features"), f"{name}_raw"), output_dim), name)
        sides.append(made.join(dense_index(made, [], "id", "idx"), "id"))
    num_left = sides[0].count()
    nodes = stack_features(*[s.select("idx", "features") for s in sides], num_left)
    names = sides[0].select("id", F.col("idx").alias("node")).unionByName(sides[1].select("id", (F.col("idx") + num_left).alias("node")))
    return nodes.join(names, "node").select("node", "side", "id", "features")
