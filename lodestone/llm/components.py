"""Connected components of a graph given as edges, by label propagation with shortcuts; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import BROADCAST_ROWS, cut, sized, written

#: Edges that a task of a round takes, about.
EDGES_EACH = 50_000
#: Rounds after which labels are written and read again (see `written`).
ROUNDS = 4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that an edge names. Every round is written to the shared folder.

    Each round gives a node the least label among its own and its neighbours', then that label's own label; a graph that is
    deep needs rounds by the logarithm of its depth in practice, a star two. Labels are broadcast where their number is small, else
    shuffled to the edges. Neighbours' labels leave the tasks as partial minima, so a hub is a row for each task; where labels are shuffled, a hub's own label
    meets all its edges in one key, which AQE's skew join splits.
    """
    both = written(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("other"))).where("id <> other").distinct())
    n = both.count()
    tasks = 2 + n // EDGES_EACH
    few = lambda df: df.coalesce(tasks) if n <= 4 * BROADCAST_ROWS else df  # noqa: E731  small graphs have small rounds
    labels = written(few(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("component"))))
    ids = labels.count()
    turn = 0
    while True:
        of = lambda names: sized(labels.select(*names), ids)
        seen = both.join(of([F.col("id").alias("other"), "component"]), "other").groupBy("id").agg(F.min("component").alias("least"))
        near = few(seen).join(of(["id", "component"]), "id").select("id", F.col("component").alias("was"), F.least("component", "least").alias("near"))
        jumped = near.join(of([F.col("id").alias("near"), F.col("component").alias("far")]), "near", "left").select("id", "was", F.least("near", "far").alias("component"))
        turn += 1
        jumped = written(jumped) if turn % ROUNDS == 0 else cut(jumped)
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.drop("was")
        if not changed:
            return written(labels)
