"""Routers: nearest prototype by cosine, and hint weights with example similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factlake.functions import text as X
from factlake.operators.dense import matrix


#: Prototypes that a plan may hold as a literal.
MOST_PROTOTYPES = 1000


def _similarities(vectors: DataFrame, prototypes: DataFrame, key: str) -> tuple[DataFrame, list]:
    """(key, scores): cosines with every prototype, in the routes' order; and the route of each.

    Prototypes are a fixed set of examples: they are read once, and every vector is compared where
    it lies, without a join or a shuffle.
    """
    rows = prototypes.select("route", F.col("route_order").cast("long"), F.col("vec").cast("array<double>")).limit(MOST_PROTOTYPES + 1).collect()
    if len(rows) > MOST_PROTOTYPES:
        raise ValueError(f"over {MOST_PROTOTYPES} prototypes; search them with operators.dense")
    rows = sorted(rows, key=lambda r: r[1])
    centres = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
    lengths = np.linalg.norm(centres, axis=1)
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(centres):
                x = matrix(b.column(1))
                both = np.linalg.norm(x, axis=1)[:, None] * lengths[None]
                score = np.round(np.where(both > 0, x @ centres.T / np.where(both > 0, both, 1.0), 0.0), 6)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), len(centres)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), listed], names=schema.names)

    return vectors.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(compare, schema), [r[0] for r in rows]


def native(vectors: DataFrame, prototypes: DataFrame, *, vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, route, score): the route of the nearest prototype.

    ``prototypes`` has (route, route_order, vec); the first route in order wins a tie.
    There is no threshold.
    """
    scored, routes = _similarities(vectors, prototypes, vec_id)
    best = F.array_max("scores")
    at = F.array_position("scores", best).cast("int")
    return scored.select(vec_id, F.element_at(F.array(*map(F.lit, routes)), at).alias("route"), best.alias("score"))


def nearest_by_route(vectors: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, near): for every route the greatest cosine of its prototypes, as a map."""
    scored, routes = _similarities(vectors, prototypes, key)
    own = {r: [i for i, x in enumerate(routes) if x == r] for r in routes}
    near = F.create_map(*[x for r, at in own.items() for x in (F.lit(r), F.array_max(F.array(*[F.get("scores", F.lit(i)) for i in at])))])
    return scored.select(key, near.alias("near"))


def heuristic_scores(question: Column) -> dict[str, Column]:
    """Per route, hint bonus plus 0.55 of the best example similarity, to six places."""
    out = {}
    for route, examples in X.ROUTE_EXAMPLES.items():
        lexical = F.greatest(*[X.lexical_similarity(question, F.lit(e)) for e in examples])
        out[route] = F.round(X.route_bonus(question, route) + 0.55 * lexical, 6)
    return out


def heuristic(questions: DataFrame) -> DataFrame:
    """(qid, route, score): the best route, the first in order on ties.

    With a column ``near`` (route to the cosine of its nearest example) 0.45 of that is added, to eight places.
    """
    scores = heuristic_scores(F.col("question"))
    if "near" in questions.columns:
        scores = {r: F.round(s + 0.45 * F.coalesce(F.element_at("near", F.lit(r)), F.lit(0.0)), 8) for r, s in scores.items()}
    ranked = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("route")) for i, (r, s) in enumerate(scores.items())]))
    return questions.select("qid", ranked.alias("b")).select("qid", F.col("b.route").alias("route"), F.col("b.s").alias("score"))
