"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

An item is contaminated into a document that holds at least ``threshold`` of the item's distinct word
shingles. The document may be thousands of times longer, so the Jaccard similarity of the two says nothing;
what is sketched is the item.

Index: items are partitioned by size (powers of two of their shingle counts), and each partition has a sketch
length of its own; an item's sketch is that many of its shingles, those of least hash. By the pigeonhole
principle an item of m shingles, of which at most floor((1 - threshold) * m) may be absent, shares one of any
floor((1 - threshold) * m) + 1, so a sketch of that length for the largest item of its partition misses nothing.
Search: a scan hashes every document's shingles and joins them with the sketches alone; a pair that meets is a
candidate. Verification: only the candidates' documents are hashed again, and the shingles that they share with the
whole item are counted exactly (distinct 64-bit hashes).

Tables that counting proves small are broadcast. Otherwise the joins shuffle: documents' shingles pass a bitmap of the
sketches' hashes first, and both sides are salted by the number of the task that read a row, so that a shingle or
an id which a third of the rows share is spread over ``SALTS`` tasks.

Words are runs of letters and digits, in lower case. An item of fewer words than a shingle is one shingle, met
where a document is that very sequence.

Edge cases: null or wordless texts contain nothing and are contained in nothing; rows with equal id count as
one document (or item) with the shingles of all; null ids are ids like any other; empty tables give
empty results; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _common
from larkspur.llm._common import fresh, materialize

#: Tasks that the rows of one key are spread over where a join shuffles.
SALTS = 16
#: Bits of the bitmap of sketch hashes, as a power of two: 512 KB whatever the number of items.
BITMAP = 22


def shingles(df: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """id, text_hash, h: distinct shingle hashes (array of long) of each row."""
    words = F.expr(f"filter(split(lower(`{text_col}`), '[^\\\\p{{L}}\\\\p{{N}}]+', -1), w -> w <> '')")
    at = ", ".join(f"get(w, i + {k})" for k in range(size))
    h = f"CASE WHEN w IS NULL OR size(w) = 0 THEN cast(array() AS array<bigint>) WHEN size(w) < {size} THEN array(xxhash64(array_join(w, ' '))) ELSE array_distinct(transform(sequence(0, size(w) - {size}), i -> xxhash64({at}))) END"
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words.alias("w")).select("id", "text_hash", F.expr(h).alias("h"))


def item_sketches(items: DataFrame, id_col="item_id", text_col="text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The index, a row for each item: item, m (distinct shingles), need (shared ones to be contaminated), part (its size class), hs (shingles by hash), sketch (the least of hs)."""
    s = shingles(items, id_col, text_col, size).select(F.col("id").alias("item"), F.explode_outer("h").alias("h")).where("h IS NOT NULL").distinct()
    per = s.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("m"), F.array_sort(F.collect_list("h")).alias("hs"))
    # the comparisons have to be exact: threshold in thousandths
    t = round(threshold * 1000)
    per = per.withColumn("part", F.expr("length(bin(m))")).withColumn("need", F.expr(f"cast(greatest(1, ceil(m * {t} / 1000)) AS int)"))
    return per.select("item", "m", "need", "part", "hs", F.expr(f"slice(hs, 1, cast(floor((shiftleft(1, part) - 1) * {1000 - t} / 1000) + 1 AS int))").alias("sketch"))


def _small(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= _common.BROADCAST_BYTES


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def _salt() -> Column:
    """By the task that reads a row: the same whenever that task runs anew."""
    return F.pmod(F.spark_partition_id(), F.lit(SALTS))


def _maybe(h: str, sketched: DataFrame) -> Column:
    """False only for hashes that no sketch holds; a bitmap of a fixed size."""
    word = F.shiftright(F.col("h"), 6).bitwiseAND(F.lit((1 << (BITMAP - 6)) - 1))
    bits = sketched.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("b")).collect()
    held = [0] * (1 << (BITMAP - 6))
    for w, b in bits:
        held[w] = b
    return F.expr(f"getbit(get(array({','.join(f'{x}L' if x > -(1 << 63) else '-9223372036854775807L - 1L' for x in held)}), cast(shiftright({h}, 6) & {len(held) - 1} AS int)), cast({h} & 63 AS int)) = 1")


def candidates(docs: DataFrame, sketched: DataFrame, n_sketched: int, doc_id="doc_id", text_col="text", size: int = 5) -> DataFrame:
    """id, text_hash, item: document rows that hold a shingle of an item's sketch. sketched: item, h."""
    # An inner explode makes Catalyst infer a filter on the array; pushed below it, that would cut the text into words
    # anew for each shingle. Outer leaves nothing to infer.
    rows = shingles(docs, doc_id, text_col, size)
    if _small(n_sketched, 32):
        rows = rows.select("id", "text_hash", F.explode_outer("h").alias("h")).join(F.broadcast(sketched), "h")
    else:
        rows = rows.select("id", "text_hash", F.explode_outer("h").alias("h")).where(_maybe("h", sketched)).withColumn("salt", _salt())
        rows = rows.join(_salted(sketched), ["h", "salt"])
    return rows.select("id", "text_hash", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id="doc_id", item_id="item_id", text_col="text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every pair at or over the threshold."""
    index = materialize(item_sketches(items, item_id, text_col, size, threshold), "decontam-items")
    n_items, n_sketched, n_shingles = index.agg(F.count(F.lit(1)), F.sum(F.size("sketch")), F.sum("m")).first()
    met = candidates(docs, index.select("item", F.explode("sketch").alias("h")), n_sketched or 0, doc_id, text_col, size)
    # a text that holds one item may share its id with the text that holds the rest: all texts of a candidate id are verified
    met = materialize(met.select("id", "item").distinct(), "decontam-candidates")
    ids = met.select("id").distinct()
    few = _small(met.count(), 64)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text_col).alias("__text"))
    if few:
        texts = texts.join(F.broadcast(ids), F.col("__id").eqNullSafe(F.col("id")), "left_semi")
        rows = shingles(texts, "__id", "__text", size).select(F.col("id").alias("of"), "h").join(F.broadcast(met), F.col("of").eqNullSafe(F.col("id")))
    else:
        texts = texts.withColumn("s", _salt()).join(_salted(ids), F.col("__id").eqNullSafe(F.col("id")) & (F.col("s") == F.col("salt")), "left_semi")
        rows = shingles(texts, "__id", "__text", size).select(F.col("id").alias("of"), "h", _salt().alias("s"))
        rows = rows.join(_salted(met), F.col("of").eqNullSafe(F.col("id")) & (F.col("s") == F.col("salt")))
    whole = index.select(F.col("item").alias("of_item"), "m", "need", "hs")
    whole = F.broadcast(whole) if _small(n_items * 40 + (n_shingles or 0), 8) else whole
    rows = rows.select("id", "item", "h").join(whole, F.col("item").eqNullSafe(F.col("of_item")))
    shared = rows.select("id", "item", "m", "need", F.explode(F.array_intersect("h", "hs")).alias("h")).distinct()
    found = shared.groupBy("id", "item", "m", "need").agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= need")
    return found.select(
        F.col("id").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("m").cast("long").alias("n_item"),
        "n_shared",
        (F.col("n_shared") / F.col("m")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id="doc_id", item_id="item_id", text_col="text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose id is in no pair."""
    name = fresh(docs.columns, "bad")
    bad = materialize(contaminated(docs, items, doc_id, item_id, text_col, size, threshold).select(F.col(doc_id).alias(name)).distinct(), "decontam")
    bad = F.broadcast(bad) if _small(bad.count(), 16) else bad
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[name]), "left_anti")
