"""Exact dedup against a persistent digest index. DataFrame functions only.

The index holds one row per distinct text (never one per copy), bucketed and sorted by digest. A new batch is reduced to
one row per digest, with map-side partial aggregation; a sort-merge anti-join against the index, which isn't shuffled,
leaves the digests that are new, and those are appended. What stays of the batch is then read off the index.

A table that is deduplicated as a whole goes through the index in batches from long to short texts, so that of equal texts
the longest is always met first and an index that only grows holds the right one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import ROW, materialize, numbered, scratch_path, without_rows

#: Deleted before texts are compared: space and U+0009 to U+000D.
WHITE = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")
#: Batches in which a whole table goes through an index.
BATCHES = 4

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


def normalized(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """Digests seen so far, as a table bucketed and sorted by digest at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, found: DataFrame, batch: str) -> None:
        """Append one row for each digest of ``found(digest, n, doc_id, row number)`` that the index hasn't got yet."""
        # bitwise_not turns the order around without overflow; nulls come lowest in max()
        best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("id"), F.bitwise_not(ROW).alias("row"))).alias("best")
        new = found.groupBy("digest").agg(best).join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        rows = new.select("digest", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"), F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").write.mode("append").insertInto(self.table)

    def close(self) -> None:
        """Forget the catalog's entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame) -> DataFrame:
    """(row number, doc_id, code points n, digest) of every row, written once."""
    digest = F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest")
    return materialize(numbered(docs).select(ROW, "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), digest), "digests")


def resolved(found: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """Every row of ``found`` with what the index holds for its text; a row of ``batches`` that is held itself is kept."""
    sizes = found.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialize(sizes.join(index.read().hint("merge"), "digest"), "groups")
    own = F.col("batch").isin(batches) & (F.col(ROW) == F.col("keep_row"))
    return found.join(groups.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(own, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), ROW
    )


def dedupe(docs: DataFrame, index: DigestIndex, batch: str = "") -> DataFrame:
    """Deduplicate a batch against itself and ``index``, and append what is new.

    Of equal texts in the batch the row with the most code points in the original text, then the smallest doc_id stays;
    if the index already has the text, none stays and keep_id is the document indexed before.

    Nulls: a null text is an empty one; a null doc_id loses every tie. Rows repeated in full count as copies: exactly
    one stays. An empty table gives an empty result. Other columns of ``docs`` are not looked at.

    Returns doc_id, keep_id, group_size (rows of the batch with the text), kept, text_sha256 and the row number.
    """
    batch = f"{batch}-{uuid.uuid4().hex}"
    found = digests(docs)
    index.add(found, batch)
    return resolved(found, index, [batch])


def dedupe_once(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Deduplicate a whole table: its rows go through a new index in ``batches``, from long to short texts.

    Rows of a digest that come in a later batch are shorter, so what the index holds by then stays; nulls, repeated rows,
    empty tables and the columns returned are as in ``dedupe``, and group_size counts rows of the whole table.
    """
    spark = docs.sparkSession
    found = digests(docs)
    shares = [1 - k / batches for k in range(1, batches)]
    bounds = sorted({int(x) for x in found.approxQuantile("n", shares, 0.01)}, reverse=True) if shares else []
    index = DigestIndex(spark, scratch_path(spark, "index"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        names = []
        for k, (below, least) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
            within = [c for c in (None if below is None else F.col("n") < below, None if least is None else F.col("n") >= least) if c is not None]
            names.append(f"{k}-{uuid.uuid4().hex}")
            index.add(found.filter(reduce(Column.__and__, within, F.lit(True))), names[-1])
        return resolved(found, index, names)
    finally:
        index.close()


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without copies: of equal texts one row stays (see ``dedupe``), with all its columns.

    Null texts count as empty and so as copies of each other; repeated rows leave one; an empty table stays empty.
    """
    rows = numbered(docs)
    return without_rows(rows, dedupe_once(rows).filter(~F.col("kept")))
