"""SimHash near-duplicate classes by the generalised pigeonhole principle.

A fingerprint has one bit for each of 64 * words hash bits; a bit is set if it is set in over half of the
shingle hashes. Fingerprints that differ in at most ``distance`` bits are linked.

The bits are grouped into partitions, correlated bits together, and each partition i gets its own threshold
t_i >= -1 (-1: not probed). Two fingerprints within ``distance`` differ in at most t_i bits of some partition
whenever sum(t_i + 1) > distance, so an index of partition keys, probed with every key within t_i bits, misses
no link. Thresholds are chosen by dynamic programming on candidate counts estimated from a sample of
fingerprints. For long distances, where that guarantee would mean comparing nearly everything, a plan can
instead be asked for a recall at that distance (``recall`` below 1): the same programme then takes
the cheapest thresholds whose misses, with independent bit flips, stay under it.

Only distinct fingerprints are indexed (a group of exact copies is one), key buckets are compared inside
sorted partitions in NumPy blocks, and every bucket emits a spanning forest of its links, never all pairs.
Buckets of more than ``block`` fingerprints are split into pairs of sub-blocks, each a group of its own, so
no task holds a whole hot bucket. Components come from alternating large-star and small-star rounds.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; texts shorter than a
shingle are one shingle; repeated ids are separate rows of possibly different classes; null ids are ignored
as class names (a class of null ids alone is named null); empty tables give empty results; columns beyond
id and text are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._common import BROADCAST_BYTES, alone, discard, materialize, small_batches, spread_join

#: Distinct fingerprints, those of least hash, that bit correlations and candidate counts are estimated from.
SAMPLE = 2048
#: Rows of a bucket compared in one group; larger ones are split into pairs of such blocks.
BLOCK = 4096
_SEED_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- fingerprints


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits from a 64-bit hash."""
    with np.errstate(over="ignore"):
        z = h + _SEED_STEP * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> np.ndarray:
    """For each column of h (n, words) the word of the bits set in over half the rows, by bit-sliced adders."""
    n, words = h.shape
    planes: list[list[np.ndarray]] = [[h]]
    counts = np.zeros(64 * words, np.int64)
    level = 0
    while level < len(planes):
        todo = planes[level]
        while todo:
            a = todo.pop()
            m = len(a)
            if m <= 24:
                counts += np.unpackbits(np.ascontiguousarray(a).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) << level
                continue
            k = m // 3
            x, y, z = a[:k], a[k : 2 * k], a[2 * k : 3 * k]
            xy = x ^ y
            if level + 1 == len(planes):
                planes.append([])
            planes[level + 1].append((x & y) | (xy & z))
            todo.append(np.concatenate([xy ^ z, a[3 * k :]]))
        level += 1
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of a UTF-8 text: A-Z lowered, words parted by ASCII blanks."""
    from xxhash import xxh64_intdigest

    ws = text.lower().split()
    if not ws:
        return np.array([], np.uint64)
    if len(ws) < shingle:
        hs = [xxh64_intdigest(b" ".join(ws), 42)]
    else:
        joined = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(ws) - shingle + 1].tolist()
        hs = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return np.array(hs, np.uint64)


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> tuple[int, ...]:
    """Fingerprint words of a UTF-8 text."""
    return _fold(shingle_hashes(text, shingle), words)


def _fold(h: np.ndarray, words: int) -> tuple[int, ...]:
    if not len(h):
        return (0,) * words
    return tuple(_majority(np.stack([h, *(_mix(h, k) for k in range(1, words))], axis=1)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id and fp, the fingerprint as 8 * words big-endian bytes."""

    def run(batches):
        import pyarrow as pa

        alone("simhash")
        for b in batches:
            fps = [b"".join(w.to_bytes(8, "big") for w in fingerprint((t.as_py() or "").encode("utf-8", "replace"), shingle, words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, fp binary")


# ---------------------------------------------------------------- the plan


def _bits(fps: np.ndarray) -> np.ndarray:
    """(n, words) uint64 to (n, 64 * words) 0/1; column j is bit j % 64 of word j // 64."""
    n, w = fps.shape
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, w * 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, width: int) -> list[list[int]]:
    """Partitions of up to ``width`` bits; each grows by the bit most correlated with it."""
    n = bits.shape[1]
    c = np.zeros((n, n))
    if len(bits) > 2:
        x = bits - bits.mean(0, keepdims=True)
        sd = np.sqrt((x * x).mean(0)) + 1e-9
        c = np.abs((x.T @ x) / len(bits) / sd[:, None] / sd[None, :])
    free, out = np.ones(n, bool), []
    while free.any():
        got = [int(np.argmax(free))]
        free[got[0]] = False
        near = c[:, got[0]].copy()
        while free.any() and len(got) < width:
            k = int(np.argmax(np.where(free, near, -1.0)))
            free[k] = False
            got.append(k)
            near += c[:, k]
        out.append(sorted(got))
    return out


def _ball(width: int, t: int) -> int:
    total, term = 0, 1
    for k in range(t + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def plan(sample: np.ndarray, n: int, distance: int, recall: float = 1.0, flips: float | None = None, widths=None, max_t: int = 2) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, at the least estimated cost.

    sample: (m, words) of distinct fingerprints; n: distinct fingerprints in all. Cost: index and probe
    rows, and candidates times 0.02. recall 1: sum(t + 1) > distance. Below 1: the product of the misses of
    fingerprints of which a share ``flips`` of bits differs (None: distance over all bits) <= 1 - recall.
    """
    bits = _bits(sample)
    total = bits.shape[1]
    best = None
    for width in widths or [x for x in (8, 11, 13, 16, 22, 32) if x <= total]:
        parts = group_bits(bits, width)
        options = []
        for p in parts:
            keys = bits[:, p].astype(np.float32)
            m = len(keys)
            if m > 1:
                d = (keys.sum(1)[:, None] + keys.sum(1)[None, :] - 2 * keys @ keys.T).round().astype(np.int64)
                hist = (np.bincount(d.ravel(), minlength=len(p) + 1)[: len(p) + 1] - np.bincount([0] * m, minlength=len(p) + 1)) / (m * (m - 1))
            else:
                hist = np.zeros(len(p) + 1)
            flip = distance / total if flips is None else flips
            opts = []
            for t in range(-1, min(max_t, len(p)) + 1):
                # where the sample saw none, independent bits
                seen = hist[: t + 1].sum() if t >= 0 else 0.0
                even = _ball(len(p), t) / 2.0 ** len(p) if t >= 0 else 0.0
                cand = max(seen, even) * n * (n - 1) / 2
                rows = 0 if t < 0 else n * (1 if t == 0 else 1 + _ball(len(p), t))
                hit = 0.0 if t < 0 else sum(_choose(len(p), k) * flip**k * (1 - flip) ** (len(p) - k) for k in range(t + 1))
                gain = t + 1 if recall >= 1 else int(round(-np.log(max(1 - hit, 1e-12)) * 100))
                opts.append((t, gain, rows + 0.02 * cand))
            options.append((p, opts))
        need = distance + 1 if recall >= 1 else int(np.ceil(-np.log(1 - recall) * 100))
        # state: gain so far, at most need -> (cost, choices)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for _, opts in options:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for g, (cost, ts) in state.items():
                for t, gain, c in opts:
                    k = min(need, g + gain)
                    if k not in new or cost + c < new[k][0]:
                        new[k] = (cost + c, (*ts, t))
            state = new
        if need in state and (best is None or state[need][0] < best[0]):
            best = (state[need][0], [(p, t) for (p, _), t in zip(options, state[need][1], strict=True) if t >= 0])
    if best is None:
        raise ValueError("no thresholds reach the distance or recall asked for")
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# ---------------------------------------------------------------- probing


def _keys(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fps), np.uint64)
    for i, j in enumerate(bits):
        key |= ((fps[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)) << np.uint64(i)
    return key


def _words(column, words: int) -> np.ndarray:
    """A binary Arrow column of 8 * words bytes a row, as (n, words) uint64."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def bucket_rows(fps: DataFrame, parts: list[tuple[list[int], int]], words: int) -> DataFrame:
    """part, key, probe, fp (node): an index row for each partition, and a probe row for each other key within t bits.

    fps: node and full, whose bits the keys are taken from.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            fp, w = b.column(0), _words(b.column(1), words)
            every = np.arange(len(w))
            for i, (bits, t) in enumerate(parts):
                key = _keys(w, bits)
                masks = [0] + [sum(1 << x for x in c) for k in range(1, t + 1) for c in combinations(range(len(bits)), k)]
                for s in range(0, len(masks), 64):
                    some = np.array(masks[s : s + 64], np.uint64)
                    ks = (key[:, None] ^ some[None, :]).ravel().view(np.int64)
                    probe = np.tile(some != 0, len(w))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ks), i, np.int16)), pa.array(ks), pa.array(probe), fp.take(pa.array(np.repeat(every, len(some))))], ["part", "key", "probe", "fp"]
                    )

    return fps.select("node", "full").mapInArrow(run, "part short, key long, probe boolean, fp binary")


def _root(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: least index of each class."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def forest(group: np.ndarray, probe: np.ndarray, side: np.ndarray, w: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (child, root) of a spanning forest of the links inside runs of equal ``group``.

    Two probes aren't compared, nor two rows of the same side 1 or 2 (sides are of split buckets; 0 meets all).
    """
    n = len(group)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))

    def linked(a, b):
        ok = ~(probe[a] & probe[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(w[a] ^ w[b]).sum(1) <= distance
        return a[ok], b[ok]

    small = sizes <= 64
    member = np.repeat(np.where(small, sizes, 0), sizes)
    place = np.arange(n) - np.repeat(starts, sizes)
    for k in range(1, int(member.max(initial=0))):
        a = np.flatnonzero(place + k < member)
        label = _root(label, *linked(a, a + k))
    for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        for i in range(s, s + m, 512):
            a = np.arange(i, min(i + 512, s + m))
            for j in range(i, s + m, 512):
                b = np.arange(j, min(j + 512, s + m))
                d = np.bitwise_count(w[a][:, None, :] ^ w[b][None, :, :]).sum(2, dtype=np.int32) <= distance
                d &= ~(probe[a][:, None] & probe[b][None, :]) & ((side[a][:, None] == 0) | (side[a][:, None] != side[b][None, :]))
                x, y = np.nonzero(d)
                label = _root(label, a[x], b[y])
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def bucket_counts(fps: DataFrame, parts: list[tuple[list[int], int]], words: int) -> DataFrame:
    """part, key, count: rows that ``bucket_rows`` makes of each bucket; the keys alone, without the fingerprints."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            w = _words(b.column(0), words)
            for i, (bits, t) in enumerate(parts):
                key = _keys(w, bits)
                masks = [0] + [sum(1 << x for x in c) for k in range(1, t + 1) for c in combinations(range(len(bits)), k)]
                for s in range(0, len(masks), 64):
                    ks = (key[:, None] ^ np.array(masks[s : s + 64], np.uint64)[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ks), i, np.int16)), pa.array(ks)], ["part", "key"])

    return fps.select("full").mapInArrow(run, "part short, key long").groupBy("part", "key").count()


def links(fps: DataFrame, parts: list[tuple[list[int], int]], words: int, node_words: int, distance: int, block: int = BLOCK) -> DataFrame:
    """a, b: nodes linked; their connected components are those of all links that the plan finds.

    fps: node (its first node_words words are those that distances are taken on) and full (all words).
    """
    rows = bucket_rows(fps, parts, words)
    counts = bucket_counts(fps, parts, words).where(F.col("count") > block)
    hot = materialize(counts.select(F.col("part").alias("p"), F.col("key").alias("k"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "simhash-hot")
    n_hot = hot.count()
    rows = rows.withColumn("group", F.xxhash64("part", "key")).withColumn("side", F.lit(0).cast("short"))
    if n_hot:
        small = F.broadcast(hot) if n_hot * 16 <= BROADCAST_BYTES else hot
        r = rows.join(small, (rows["part"] == hot["p"]) & (rows["key"] == hot["k"]), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # block i meets block j in group (i, j), i <= j: side 1 for i, side 2 for j, 0 within a block
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.struct(
                F.xxhash64(F.col("group"), F.least(own, j), F.greatest(own, j)).alias("group"),
                F.when(own == j, 0).when(own < j, 1).otherwise(2).cast("short").alias("side"),
            ),
        )
        single = F.array(F.struct(F.col("group"), F.col("side")))
        rows = r.withColumn("g", F.explode(F.when(F.col("blocks").isNull(), single).otherwise(pairs))).select("part", "key", "probe", "fp", F.col("g.group").alias("group"), F.col("g.side").alias("side"))

    def run(batches):
        import pyarrow as pa

        alone("simhash")
        held = None
        for b in _with_end(batches):
            parts_of = [x for x in (held, b) if x is not None and x.num_rows]
            if not parts_of:
                continue
            t = pa.Table.from_batches(parts_of).combine_chunks()
            group = t.column("group").to_numpy()
            # the last run may go on in the next batch
            cut = len(group) if b is None else int(np.searchsorted(group, group[-1], "left"))
            held = None if b is None else t.slice(cut).combine_chunks().to_batches()[0]
            if not cut:
                continue
            t = t.slice(0, cut)
            fp = t.column("fp").combine_chunks()
            w = _words(fp, len(fp[0].as_py()) // 8)
            probe, side = t.column("probe").to_numpy(), t.column("side").to_numpy()
            child, root = forest(group[:cut], probe, side, w[:, :node_words], distance)
            if len(child):
                yield pa.RecordBatch.from_arrays([fp.take(pa.array(child)), fp.take(pa.array(root))], ["a", "b"])

    out = rows.select("group", "probe", "side", "fp").repartition("group").sortWithinPartitions("group").mapInArrow(run, "a binary, b binary")
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_end(batches):
    yield from batches
    yield None


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component. edges: a, b with a > b; a node on no edge is left out.

    Alternating stars. Of a heavy centre only the centre's least neighbour is broadcast (``spread_join``).
    Each round's tables are deleted once the next is written.
    """
    e = materialize(edges.select("a", "b").distinct(), "cc")
    n = e.count()
    while True:
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        least = materialize(least, "cc-least")
        large = spread_join(both.where("v > u"), least, "u", "c", 2 * n)
        large = materialize(large.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        # small star: u and its smaller neighbours go to the least of those
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")), "cc-least")
        small = spread_join(large, lower, "a", "c", n)
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        new = materialize(new.distinct(), "cc")
        n_new = new.count()
        settled = n_new == n and new.join(e, ["a", "b"], "left_anti").isEmpty()
        discard(e, least, large, lower)
        e, n = new, n_new
        if settled:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _named(distinct: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """node, root, many and component_id, the least ``id_col`` of the class. distinct: node, many, id_col."""
    named = materialize(distinct.join(roots, "node", "left").select("node", "many", id_col, F.coalesce("root", "node").alias("root")), "simhash-roots")
    ids = named.groupBy("root").agg(F.min(id_col).alias("component_id"), F.count(F.lit(1)).alias("c"))
    ids = materialize(ids.where("c > 1"), "simhash-classes")
    # nearly all classes are of one node and need no join
    many = spread_join(named.drop(id_col), ids, "root", "c", named.count())
    one = named.join(ids, "root", "left_anti").select("root", "node", "many", F.col(id_col).alias("component_id"))
    return materialize(many.unionByName(one), "simhash-named")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=3, words=1, node_words=None, distance=3, recall=1.0, flips=None, sample=SAMPLE, block=BLOCK) -> DataFrame:
    """doc_id, fp and component_id (least doc_id of the class): a row for each input row.

    words: length of a fingerprint; node_words: its leading words on which ``distance`` is taken (all, if
    None). recall below 1 and flips: see ``plan``.
    """
    node_words = node_words or words
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, words), "simhash-fps").withColumn("node", F.substring("fp", 1, 8 * node_words))
    distinct = fps.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("fp").alias("full"), F.count(F.lit(1)).alias("many"))
    distinct = materialize(distinct, "simhash-distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("many"), F.lit(0))).first()
    if n < 2:
        return fps.select("doc_id", "fp", F.lit(distinct.agg(F.min("least_id")).first()[0]).cast("long").alias("component_id"))
    parts = plan(_sample(distinct, words, sample), n, distance, recall, flips)
    named = _named(distinct.drop("full"), components(links(distinct, parts, words, node_words, distance, block)), "least_id")
    return spread_join(fps, named.drop("root"), "node", "many", total).select("doc_id", "fp", "component_id")


def _sample(distinct: DataFrame, words: int, sample: int) -> np.ndarray:
    some = [bytes(r[0]) for r in distinct.select("full").orderBy(F.xxhash64("full"), "full").limit(sample).collect()]
    return np.frombuffer(b"".join(some), ">u8").astype(np.uint64).reshape(-1, words)


# ---------------------------------------------------------------- verified similarity

#: Bytes that name a shingle set: its size in 4, then a hash of it.
SET_BYTES = 16
#: Shingles of a block; loose classes of more are split into pairs of such blocks.
BLOCK_SHINGLES = 1 << 17


def _set_name(h: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return len(h).to_bytes(4, "big") + xxh3_128_digest(h.tobytes())[: SET_BYTES - 4]


def similar_forest(sizes: np.ndarray, hashes: np.ndarray, side: np.ndarray, per_mille: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (child, root) of a spanning forest of the pairs of sets whose Jaccard similarity is per_mille / 1000 or more, counted exactly.

    hashes: the distinct hashes of each set, one set after the other. Rows of the same side 1 or 2 aren't paired.
    Intersections are products of 0/1 matrices over the hashes that two sets have, taken in slices.
    """
    n = len(sizes)
    label = np.arange(n)
    _, at, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), sizes), seen[at] > 1
    row, at = row[shared], np.unique(at[shared], return_inverse=True)[1]
    width = int(at.max(initial=-1)) + 1
    order = np.argsort(at, kind="stable")  # by hash, and by row within
    row, at = row[order], at[order]
    many = sizes.astype(np.int64)
    step, slice_ = 512, 4096
    cuts = np.searchsorted(at, np.arange(0, width + slice_, slice_))
    for i in range(0, n, step):
        for j in range(i, n, step):
            a, b = min(step, n - i), min(step, n - j)
            both = np.zeros((a, b), np.float32)
            for c in range(len(cuts) - 1):
                r, k = row[cuts[c] : cuts[c + 1]], at[cuts[c] : cuts[c + 1]] - c * slice_
                in_a, in_b = (r >= i) & (r < i + a), (r >= j) & (r < j + b)
                if not in_a.any() or not in_b.any():
                    continue
                x = np.zeros((a, min(slice_, width - c * slice_)), np.float32)
                x[r[in_a] - i, k[in_a]] = 1
                if i == j:
                    y = x
                else:
                    y = np.zeros((b, x.shape[1]), np.float32)
                    y[r[in_b] - j, k[in_b]] = 1
                both += x @ y.T
            common = both.astype(np.int64)
            ok = common * 1000 >= per_mille * (many[i : i + a, None] + many[None, j : j + b] - common)
            ok &= (side[i : i + a, None] == 0) | (side[i : i + a, None] != side[None, j : j + b])
            x, y = np.nonzero(ok)
            x, y = x + i, y + j
            label = _root(label, x[x < y], y[x < y])
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """node and hs, the distinct shingle hashes, of each row. texts: node, text."""

    def run(batches):
        import pyarrow as pa

        alone("simhash")
        for b in batches:
            for i in range(0, b.num_rows, 256):
                hs = [np.unique(shingle_hashes((t or "").encode("utf-8", "replace"), shingle)) for t in b.column(1).slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array([h.view(np.int64) for h in hs], pa.list_(pa.int64()))], ["node", "hs"])

    return texts.mapInArrow(run, "node binary, hs array<bigint>")


def _verified(loose: DataFrame, sets: DataFrame, per_mille: int, block: int) -> DataFrame:
    """a, b: links inside loose classes that hold exactly. loose: node, root, size; sets: node, hs."""
    sums = loose.groupBy("root").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"))
    hot = sums.where(F.col("s") > block).select("root", "c", F.ceil(F.col("s") / block).cast("int").alias("blocks"))
    hot = materialize(hot, "simhash-hot")
    total = loose.count()
    split = spread_join(loose, hot, "root", "c", total)
    whole = loose.join(hot, "root", "left_anti") if hot.isEmpty() else loose.join(F.broadcast(hot.select("root")) if hot.count() * 96 <= BROADCAST_BYTES else hot.select("root"), "root", "left_anti")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.xxhash64("root", F.least(own, j), F.greatest(own, j)).alias("group"), F.when(own == j, 0).when(own < j, 1).otherwise(2).cast("short").alias("side")),
    )
    split = split.select("node", F.explode(pairs).alias("g")).select("node", "g.group", "g.side")
    dealt = whole.select("node", F.xxhash64("root").alias("group"), F.lit(0).cast("short").alias("side")).unionByName(split)
    rows = dealt.join(sets, "node").select("group", "side", "node", "hs")

    def run(batches):
        import pyarrow as pa

        alone("simhash")
        held: list = []

        def links():
            t = pa.Table.from_batches(held).combine_chunks()
            hs = t.column("hs").combine_chunks()
            node = t.column("node").combine_chunks()
            sizes = hs.value_lengths().to_numpy(zero_copy_only=False)
            child, root = similar_forest(sizes, hs.flatten().to_numpy(), t.column("side").to_numpy(), per_mille)
            return pa.RecordBatch.from_arrays([node.take(pa.array(child)), node.take(pa.array(root))], ["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            group = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() + [len(group)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and group[s] != last:
                    yield links()
                    held.clear()
                held.append(b.slice(s, e - s))
                last = group[s]
        if held:
            yield links()

    out = rows.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a binary, b binary")
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, shingle=5, similarity=0.8, words=12, node_words=8, distance=104, recall=0.999, flips=None, sample=SAMPLE, block=BLOCK, block_shingles=BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, component_id and first: a row for each input row.

    docs: doc_id and text. Texts link whose distinct shingles have a Jaccard similarity of at least ``similarity`` (in
    thousandths). Fingerprints of distinct shingles find loose classes, the components of pairs within ``distance``; inside each loose
    class all pairs are then counted exactly, in place, and only a spanning forest of what holds is given out.
    component_id: the least doc_id of the class; first: whether the row's (doc_id, text_hash) is the class's least, nulls last.
    """
    small_batches(docs.sparkSession)
    per_mille = round(similarity * 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))

    def run(batches):
        import pyarrow as pa

        alone("simhash")
        for b in batches:
            fps, names = [], []
            for t in b.column(1):
                h = np.unique(shingle_hashes((t.as_py() or "").encode("utf-8", "replace"), shingle))
                fps.append(b"".join(w.to_bytes(8, "big") for w in _fold(h, words)))
                names.append(fps[-1][: 8 * node_words] + _set_name(h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(names, pa.binary())], ["doc_id", "text_hash", "full", "node"])

    fps = materialize(docs.mapInArrow(run, "doc_id long, text_hash long, full binary, node binary"), "simhash-fps")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = materialize(fps.groupBy("node").agg(F.min(key).alias("least"), F.min("full").alias("full"), F.count(F.lit(1)).alias("many")), "simhash-distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("many"), F.lit(0))).first()
    if n < 2:
        named = distinct.select("node", "many", F.col("least").alias("component_id"))
    else:
        parts = plan(_sample(distinct, words, sample), n, distance, recall, flips)
        loose = components(links(distinct, parts, words, node_words, distance, block))
        loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
        size = F.conv(F.hex(F.substring("node", 8 * node_words + 1, 4)), 16, 10).cast("long")
        loose = materialize(loose.distinct().withColumn("size", size), "simhash-loose")
        # one row of the documents stands for each node of a loose class
        need = loose.join(distinct, "node").select("node", F.col("least.doc_id").alias("of_id"), F.col("least.text_hash").alias("of_hash"))
        need = materialize(need, "simhash-need")
        few = F.broadcast(need) if need.count() * 128 <= BROADCAST_BYTES else need
        texts = docs.join(few, docs["doc_id"].eqNullSafe(F.col("of_id")) & (docs["text_hash"] == F.col("of_hash"))).select("node", "text")
        sets = materialize(_hashed(texts.groupBy("node").agg(F.first("text").alias("text")), shingle), "simhash-sets")
        named = _named(distinct.select("node", "many", "least"), components(_verified(loose, sets, per_mille, block_shingles)), "least")
        discard(loose, need, sets)
    out = spread_join(fps.drop("full"), named.select("node", "many", "component_id"), "node", "many", total)
    first = F.col("doc_id").eqNullSafe(F.col("component_id.doc_id")) & (F.col("text_hash") == F.col("component_id.text_hash"))
    return out.select("doc_id", "text_hash", F.col("component_id.doc_id").alias("component_id"), first.alias("first"))
