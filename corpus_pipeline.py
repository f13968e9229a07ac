"""The corpus pipeline: quality rules, exact dedup, near dedup, secret scan and packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept;
its result is written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm import exact, jaccard, packing, quality, secrets
from keystrata.llm.scratch import Scratch, rows_without, sweep


def _plain(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with its columns numbered (``_0, _1, ...``), so that none has a name that a stage uses, beside ``own`` columns."""
    named = [F.col(_quoted(c)).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*named, *(F.col(c).alias(f"own_{c}") for c in own))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _named(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(like.columns)))


def _without(spark: SparkSession, docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the ids in ``gone``, which is stored; most texts that stay are not shuffled."""
    gone = Scratch(spark, name).keep(gone.select(F.col("doc_id").alias("own_doc_id")), "gone")
    return _named(rows_without(_plain(docs, "doc_id"), gone, "own_doc_id"), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Each row is judged by its own text: null and empty texts have no words and go, very long ones
    are judged whole, repeated rows share a verdict, an empty table stays empty, other columns stay as they are.
    """
    return quality.keep_good(docs)


#: Largest ``doc_id``.
_LAST = 2**63 - 1


def _shared_ids(docs: DataFrame) -> DataFrame:
    """Ids (``doc_id``) that do not name one row: null and repeated ones."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR doc_id IS NULL").select("doc_id")


def _sha(text: str) -> Column:
    return F.sha2(F.encode(exact._normal(text), "UTF-8"), 256)


def _own_rows(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with one row for each id and text, and ``id, text`` for an operator, both stored.

    Ids that are null or shared give way to ids from id and text that come after all others.
    Of rows with the same id and text one stays.
    """
    shared = _shared_ids(docs).withColumn("own_shared", F.lit(True))
    rows = _plain(docs, "doc_id", "text").join(shared.select(F.col("doc_id").alias("own_doc_id"), "own_shared"), "own_doc_id", "left")
    other = F.xxhash64("own_doc_id", "own_text").bitwiseAND(F.lit(_LAST)).bitwiseOR(F.lit(2**62))
    odd = F.col("own_doc_id").isNull() | F.coalesce("own_shared", F.lit(False))
    rows = rows.withColumn("own_id", F.when(odd, other).otherwise(F.col("own_doc_id")))
    rows = Scratch(spark, name).keep(rows, "rows")
    again = F.row_number().over(Window.partitionBy("own_id", F.xxhash64("own_text")).orderBy(F.lit(1))) == 1
    rows = rows.where("own_shared IS NULL AND own_doc_id IS NOT NULL").unionByName(
        rows.where("own_shared OR own_doc_id IS NULL").withColumn("own_first", again).where("own_first").drop("own_first")
    )
    return rows, rows.select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the one with most code points, then the smallest ``doc_id``.

    Rows, not ids, go: where ids repeat or are null (a null one comes last), rows are told apart by id
    and text; of rows that share both one stays.  Null and empty texts are equal.  Very long texts are compared whole, an empty table stays empty, other columns stay as they are.
    """
    if _shared_ids(docs).isEmpty():
        gone = exact.exact_dedup(docs.select("doc_id", "text")).where("NOT kept")
        return _without(spark, docs, gone, "pipeline-exact")
    rows = _plain(docs, "doc_id", "text").withColumns({"own_id": F.coalesce("own_doc_id", F.lit(_LAST)), "own_sha": _sha("own_text")})
    ledger = exact.exact_dedup(rows.select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"))).where("group_size > 1")
    said = ledger.groupBy(F.col("doc_id").alias("own_id"), F.col("text_sha256").alias("own_sha")).agg(
        F.max("kept").alias("own_kept"), F.count(F.lit(1)).alias("own_n")
    )
    said = Scratch(spark, "pipeline-exact").keep(said.where("NOT own_kept OR own_n > 1"), "said")
    rest = rows.join(said, ["own_id", "own_sha"], "left_anti")
    first = F.row_number().over(Window.partitionBy("own_id", "own_sha").orderBy(F.char_length("own_text").desc(), "own_text"))
    again = rows.join(said.where("own_kept"), ["own_id", "own_sha"], "left_semi").withColumn("own_rank", first).where("own_rank = 1")
    return _named(rest, docs).unionByName(_named(again, docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest ``doc_id`` stays.

    Rows, not ids, go: rows whose ids repeat or are null are compared under ids of their own that come
    after all others; of rows with the same id and text one stays.  Texts without words are linked with nothing and stay.
    Very long texts are compared whole, an empty table stays empty, other columns stay as they are.
    """
    if _shared_ids(docs).isEmpty():
        gone = jaccard.jaccard_join(docs.select("doc_id", "text")).where("component_id <> doc_id")
        return _without(spark, docs, gone, "pipeline-near")
    rows, own = _own_rows(spark, docs, "pipeline-near")
    gone = jaccard.jaccard_join(own).where("component_id <> doc_id").select(F.col("doc_id").alias("own_id"))
    return _named(rows.join(gone, "own_id", "left_anti"), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; ``n_chars``, where there is one, follows the text.

    Every row stays.  Null texts stay null, repeated rows are changed alike, very long texts are scanned
    whole, an empty table stays empty, other columns stay as they are.
    """
    rows = secrets.scan(_plain(docs, "text").withColumnRenamed("own_text", "text"))
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    new = {place["text"]: F.col("redacted")}
    if "n_chars" in place:
        changed = F.char_length("redacted").cast(docs.schema["n_chars"].dataType)
        new[place["n_chars"]] = F.when(F.size("findings") > 0, changed).otherwise(F.col(place["n_chars"]))
    return rows.select(*(new.get(at, F.col(at)).alias(c) for c, at in place.items()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences (columns of ``packing.pack``).

    Null texts count as empty and give their end mark; very long ones are cut into pieces;
    repeated rows are packed each; an empty table gives an empty result; other columns are left out.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL cannot express packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        sweep(spark, scratch)  # the working tables of the stage
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
