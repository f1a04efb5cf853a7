"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each document of a source expects ``rate = target / source size`` copies. Documents are put in one
order within their source, the expected copies are prefix-summed, a random offset per source is added,
and a document is emitted once for every integer boundary that its interval crosses. Expected copies
are fixed-point integers (1 / 2**24), so sums are exact and reruns agree.

The order is by size class, then a residue of the MD5 of id and text, then size, id and that MD5. Sorting by size
stratifies the systematic sample, so the words taken, not only the documents, come near the target. A source is split
into blocks (size class, residue, finer size); only block counts are prefix-summed across a source, so a source
with a third of all rows is spread over thousands of groups, and over more the more rows there are, even where all
its ids are null or equal. Targets are computed over one row for each source, in one task: bounded by the number of
sources, not of documents.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last; repeated ids are
separate rows (rows equal in id and text are interchangeable); an empty table gives an empty result; other
columns aren't looked at and come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm._common import broadcast_if_small, fresh, materialize, n_words

ONE = 1 << 24
#: Residues of a size class within a source, and rows for each before size classes are cut into finer blocks.
RESIDUES, ROWS = 64, 100_000


def fineness(n_rows: int) -> int:
    """Further bits of the size that blocks are cut by. The order within a residue is by size, so they change no order."""
    out = 0
    while (RESIDUES << out) * ROWS < n_rows and out < 32:
        out += 1
    return out


def tie(id_col: str, text_col: str) -> Column:
    """MD5 of id and text: parts blocks, and orders rows of equal size and id."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))).cast("binary"))


def with_blocks(sized: DataFrame, fine: int = 0) -> DataFrame:
    """sized (id, source, size, tie and others) with the columns of its block: key (of the source), bin, sub, fine."""
    return sized.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        F.expr("CASE WHEN size <= 0 THEN 0 ELSE length(bin(size)) * 8 + cast(shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7 AS int) END").alias("bin"),
        F.expr(f"cast(cast(conv(substring(tie, 1, 8), 16, 10) AS bigint) % {RESIDUES} AS int)").alias("sub"),
        F.expr(f"shiftright(size, greatest(length(bin(size)) - {4 + fine}, 0))").alias("fine"),
    )


def source_targets(blocks: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix-1") -> DataFrame:
    """One row per source: key, source_size, target, expect (fixed point), offset (fixed point).

    blocks: source, n, w (documents and words). Targets share all words by weight, none above ``cap``
    times its source's size: the capped sources are those before the first, in order of size per
    weight, whose share of what the ones before leave fits under its cap.
    """
    per = blocks.groupBy("source").agg(F.sum("n").alias("n"), F.sum("w").alias("source_size"))
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    order = W.partitionBy().orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    per = (
        per.withColumn("i", F.row_number().over(order))
        .withColumn("left_words", F.sum("source_size").over(every) - cap * (F.sum("source_size").over(order) - F.col("source_size")))
        .withColumn("left_weight", F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight"))
    )
    fits = F.col("left_words") * 1.0 * F.col("weight") <= F.col("source_size") * 1.0 * cap * F.col("left_weight")
    per = per.withColumn("k", F.min(F.when(fits, F.col("i"))).over(every))
    at_k = [F.max(F.when(F.col("i") == F.col("k"), F.col(c))).over(every).alias(c) for c in ("left_words", "left_weight")]
    per = per.select("source", "n", "source_size", "weight", "i", "k", *at_k)
    target = F.when(F.col("i") < F.col("k"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("left_words")).cast("double") / F.col("left_weight"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return per.withColumn("target", target).select(
        key.alias("key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(ONE) / F.col("source_size"))).otherwise(0).cast("long").alias("expect"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 6), 16, 10).cast("long").alias("offset"),
    )


BLOCK_COLUMNS = ["key", "bin", "sub", "fine"]


def mix(sized: DataFrame, blocks: DataFrame, n_blocks: int, weights=(5, 2, 1), cap=3, seed="mix-1") -> DataFrame:
    """sized without its block, and source_size, target and copies of each row.

    sized: from ``with_blocks``. blocks: its counts, from ``count_blocks``. n_blocks: rows of it, for the broadcasts' bound;
    beyond that the join shuffles by block, as the ranking has done already.
    """
    targets = source_targets(blocks, weights, cap, seed)
    ahead = W.partitionBy("key").orderBy("bin", "sub", "fine").rowsBetween(W.unboundedPreceding, -1)
    at = blocks.select(*BLOCK_COLUMNS, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    at = at.join(broadcast_if_small(targets, n_blocks, 200), "key").select(*BLOCK_COLUMNS, "ahead", "source_size", "target", "expect", "offset")
    inside = W.partitionBy(*BLOCK_COLUMNS).orderBy("size", F.col("id").asc_nulls_first(), "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = sized.withColumn("rank", F.count(F.lit(1)).over(inside)).join(broadcast_if_small(at, n_blocks, 120), BLOCK_COLUMNS)
    end = F.col("expect") * (F.col("ahead") + F.col("rank")) + F.col("offset")
    copies = F.shiftright(end, 24) - F.shiftright(end - F.col("expect"), 24)
    return rows.select(*[c for c in sized.columns if c not in BLOCK_COLUMNS], "source_size", "target", copies.cast("long").alias("copies"))


def count_blocks(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source", *BLOCK_COLUMNS).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))


def _mixed(docs: DataFrame, text_col: str, id_col: str, source_col: str, weights, cap: int, seed: str) -> DataFrame:
    """row (the given row whole), size, source_size, target, copies. The texts are read twice: to count blocks, and for the result."""
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), tie(id_col, text_col).alias("tie"))
    sized = with_blocks(sized, fineness(docs.count()))
    blocks = materialize(count_blocks(sized), "mix-blocks")
    return mix(sized, blocks, blocks.count(), weights, cap, seed)


def mix_documents(docs: DataFrame, text_col="text", id_col="doc_id", source_col="source", weights=(5, 2, 1), cap=3, seed="mix-1") -> DataFrame:
    """docs with mix_size (words), mix_source_size, mix_target and mix_copies added; a name that docs has gets underscores added."""
    mixed = _mixed(docs, text_col, id_col, source_col, weights, cap, seed)
    return mixed.select("row.*", *[F.col(c).alias(fresh(docs.columns, f"mix_{c}")) for c in ("size", "source_size", "target", "copies")])


def expand(docs: DataFrame, text_col="text", id_col="doc_id", source_col="source", weights=(5, 2, 1), cap=3, seed="mix-1") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    mixed = _mixed(docs, text_col, id_col, source_col, weights, cap, seed).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
