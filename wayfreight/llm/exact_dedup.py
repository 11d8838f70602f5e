"""Exact duplicates by two passes of Bloom filtering, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import UPPER, by_row, stored, without

#: The filter has 16 bits a row, but no more than this; the broadcast holds at most a 64th of it in rows of 16 bytes.
MOST_FILTER_BITS = 1 << 27


def normal_text(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, every other character as it is."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def _slots(bits: int) -> list[Column]:
    """Two positions in the filter, from disjoint parts of the digest."""
    parts = (F.substring("sha", 1, 15), F.substring("sha", 17, 15))
    return [F.pmod(F.conv(p, 16, 10).cast("bigint"), F.lit(bits)) for p in parts]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_filter_bits: int = MOST_FILTER_BITS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z; of equal texts the row with the largest id
    stays. Pass one reads the texts once, stores (id, digest) and counts, per filter position, how many
    digests set it: map tasks send at most one row for each position. Positions set twice or more are
    the filter. It goes to every task; its size is bounded by ``most_filter_bits / 64`` rows of two
    longs. Pass two tests every digest; those with both positions set may be repeated and are the only
    rows that shuffle. What fails the test is unique for certain and passes straight through. A full
    filter would let more rows shuffle, never change the result.

    A third of all rows may be copies of one text: counts and largest ids combine before the shuffle,
    and the groups come from a stored table, so that the join's exchanges stand alone and adaptive
    execution can split a hot digest.

    Defined cases: a null text counts as empty, and empty texts equal each other. A null id is smaller
    than any other; in a group with null ids only, keep_id is null and all rows stay. Rows that repeat
    the largest id all stay. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.sha2(normal_text(docs[text_col]), 256).alias("sha")
    )
    rows = stored(rows, "exact-dedup-digests")
    bits = 1 << max(12, min(most_filter_bits, 16 * rows.count()).bit_length() - 1)

    position = F.explode(F.array(*_slots(bits))).alias("slot")
    repeated = rows.select(position).groupBy("slot").count().filter("count > 1")
    words = repeated.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set_bits")
    )
    words = stored(words, "exact-dedup-filter")

    tested = rows
    for k, slot in enumerate(_slots(bits)):
        part = F.broadcast(words.select(F.col("word").alias(f"word{k}"), F.col("set_bits").alias(f"bits{k}")))
        tested = tested.withColumn(f"slot{k}", slot).join(part, F.shiftright(f"slot{k}", 6) == F.col(f"word{k}"), "left")
    maybe = F.lit(True)
    for k in range(2):
        bit = F.expr(f"(shiftright(bits{k}, cast(slot{k} % 64 as int)) & 1L) = 1L")
        maybe = maybe & F.coalesce(bit, F.lit(False))
    tested = tested.select("doc_id", "sha", maybe.alias("maybe"))

    candidates = tested.filter("maybe").select("doc_id", "sha")
    groups = stored(
        candidates.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "exact-dedup-groups",
    ).withColumnRenamed("sha", "group_sha")
    # The hint keeps both exchanges: a merge join is what adaptive execution splits when a digest is hot.
    grouped = candidates.join(groups.hint("merge"), F.col("sha") == F.col("group_sha")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"
    )
    alone = tested.filter("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(grouped).withColumnRenamed("sha", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each_row: bool = False) -> DataFrame:
    """The documents that stay, all columns as they are. Only the ids of copies meet the texts again.

    With ``each_row`` just one row of a group stays, also where ids are null or repeat.
    """
    if each_row:
        return by_row(docs, id_col, lambda rows, row: drop_exact_copies(rows, row, text_col))
    verdicts = exact_dedup(docs, id_col, text_col)
    dropped = stored(verdicts.filter("NOT kept").select(F.col("doc_id").alias(id_col)), "exact-dedup-dropped")
    return without(docs, dropped, id_col)
