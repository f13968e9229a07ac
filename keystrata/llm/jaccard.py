"""N-gram Jaccard join of documents: size-aware heavy-light join, and the groups it makes.

Small sets are joined by fixed-size subsets: every pair of tokens of a set's prefix is a key.
For large sets that would be too many keys; they are joined by scanning the inverted lists of
single prefix tokens.  The boundary is the size at which the counted cost of the two is least
(:func:`.setjoin.subset_boundary`).  What both find is compared by whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin


def linked_classes(engine: setjoin.Engine) -> DataFrame:
    """``class, root`` of all classes that are linked with another one."""
    lists = engine.scratch.keep(engine.lists(), "lists")
    keys = setjoin.join_keys(lists, setjoin.subset_boundary(lists))
    return setjoin.components(engine.links(keys, "forest", "alive", "lists"), engine.scratch, "all")


def component_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, c1, c2, root1, root2``: every row with its class and its component (null without words or id)."""
    engine = setjoin.Engine(docs, "jaccard")
    roots = linked_classes(engine).select(
        F.col("class.c1").alias("c1"), F.col("class.c2").alias("c2"), F.col("root.c1").alias("r1"), F.col("root.c2").alias("r2")
    )
    return engine.ledger.join(roots, ["c1", "c2"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), "c1", "c2", F.coalesce("r1", "c1").alias("root1"), F.coalesce("r2", "c2").alias("root2")
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Documents link when 100 * common >= 80 * united of their sets of lower-cased five-word
    shingles.  Without words (or text) a set is empty and linked with nothing.  Rows that repeat
    an id are judged by their own texts: each has the smallest id that it reaches, so two
    components may bear the same id.  A row without ``doc_id`` is returned alone with a null
    ``component_id``.  An empty table gives an empty result; other columns are ignored.
    """
    rows = component_rows(docs)
    least = rows.where("root1 IS NOT NULL").groupBy("root1", "root2").agg(F.min("doc_id").alias("least"))
    return rows.join(least, ["root1", "root2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
