"""The pipeline on a small corpus: each stage keeps what it should."""

import random
import struct
import tempfile
import zlib
from collections import Counter

import corpus_pipeline as P
from larkspur.llm import mixing, queries, simhash
from pyspark.sql import Row
from pyspark.sql import functions as F


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_deduplicate(spark, documents):
    rng = random.Random(10)
    vocab = [f"word{i}" for i in range(2000)]
    base = [[rng.choice(vocab) for _ in range(400)] for _ in range(60)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(base)]
    near = []
    for i in range(60):
        w = list(base[i])
        for _ in range(3):
            w[rng.randrange(len(w))] = "edited"
        near.append((1000 + i, " ".join(w), "s"))
    rows += near + [(2000, rows[0][1], "s"), (2001, rows[0][1], "s"), (None, "a null id", "s"), (3000, None, "s")]
    assert min(jaccard(rows[i][1], near[i][1]) for i in range(60)) > 0.9
    kept = P.deduplicate(spark, documents(rows), "")
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(60), 3000] and ids.count(None) == 1
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert P.deduplicate(spark, documents([]), "").count() == 0


def test_deduplicate_around_the_threshold(spark, documents):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(5000)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(200)]
        rows.append((i, " ".join(w), "s"))
        edits = rng.choice([3, 4, 4, 4, 5, 6, 7])
        for k in range(edits):
            w[5 + 190 * k // edits + rng.randrange(8)] = f"edit{k}"
        rows.append((1000 + i, " ".join(w), "s"))
    alike = [jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(150)]
    assert sum(0.65 < j < 0.8 for j in alike) > 40 and sum(0.8 <= j < 0.85 for j in alike) > 20
    want = sorted([*range(150), *(1000 + i for i, j in enumerate(alike) if j < 0.8)])
    assert sorted(r.doc_id for r in P.deduplicate(spark, documents(rows), "").collect()) == want


def test_deduplicate_counts_a_repeated_line_once(spark, documents):
    rng = random.Random(12)
    text = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    line, one = text(12), text(300)
    apart = [(i, "\n".join([line] * 20 + [text(300)]), "s") for i in range(20)]
    same = [(100, one + "\n" + "\n".join([line] * 2), "s"), (101, one + "\n" + "\n".join([line] * 40), "s")]
    assert jaccard(same[0][1], same[1][1]) == 1 and jaccard(apart[0][1], apart[1][1]) < 0.1
    assert sorted(r.doc_id for r in P.deduplicate(spark, documents(apart + same), "").collect()) == [*range(20), 100]


def test_deduplicate_keeps_unlike_rows_of_one_id(spark, documents):
    rng = random.Random(13)
    text = lambda: " ".join(f"word{rng.randrange(5000)}" for _ in range(100))
    a, b = text(), text()
    rows = [(5, a, "s"), (5, b, "s"), (5, a, "s"), (None, text(), "s"), (None, b + " more", "s"), (-7, text(), "s")]
    want = sorted([(5, a), (5, b), (None, rows[3][1]), (-7, rows[5][1])], key=str)
    for d in (documents(rows), documents(rows).repartition(5)):
        d = d.withColumn("of_id", F.lit("x")).withColumn("first", F.lit(1)).withColumn("node", F.lit(2))
        kept = P.deduplicate(spark, d, "")
        assert kept.columns == d.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


def test_deduplicate_large_group_in_blocks(spark, documents):
    """A group of near copies, some linked only through others, split into blocks: against brute force."""
    rng = random.Random(14)
    base = [f"word{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(24), rng.randint(0, 5)):
            w[5 * k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w), "s"))
    root = list(range(160))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(160):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in range(160)}
    assert 10 < len(set(want.values())) < 150
    for block in (1 << 17, 500):
        found = simhash.similar(documents(rows).select("doc_id", "text"), flips=P.FLIPS, distance=P.DISTANCE, block=32, block_shingles=block)
        assert {r.doc_id: r.component_id for r in found.collect()} == want


CLASHES = ("score", "predicted", "size", "row", "n", "bad", "id", "key", "h", "count", "component_id", "group")


def clashing(d):
    for c in CLASHES:
        d = d.withColumn(c, F.lit("mine"))
    return d


def test_classify(spark, documents, odd):
    good = [" ".join(random.Random(i).choice(["the", "river", "of", "stone", "walks", "under", "light", "green"]) for _ in range(80)).capitalize() + "." for i in range(240)]
    bad = ["%% $$ || BUY!! " * 40 for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 240, 2)] + [(240, 0), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    with tempfile.TemporaryDirectory() as folder:
        labels.write.parquet(f"file://{folder}/labels.parquet")
        d = clashing(documents(rows))
        kept = P.classify(spark, d, f"file://{folder}")
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == d.columns and set(range(240)) <= set(ids) and len([i for i in ids if i >= 240]) <= 2
        assert P.classify(spark, documents([]), f"file://{folder}").count() == 0
        assert P.classify(spark, clashing(documents(odd)), f"file://{folder}").count() <= len(odd)


def test_decontaminate(spark, documents, odd):
    with tempfile.TemporaryDirectory() as folder:
        item = " ".join(f"word{i}" for i in range(20))
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
        d = clashing(documents(odd + [(50, "so " * 5000 + item, "s"), (51, item[:60], "s"), (50, "another text", "s")]))
        kept = P.decontaminate(spark, d, f"file://{folder}")
        assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(map(str, d.where("doc_id IS NULL OR doc_id <> 50").collect()))
        assert P.decontaminate(spark, documents([]), f"file://{folder}").count() == 0


def test_mix(spark, documents, odd):
    d = clashing(documents(odd + [(100 + i, "word " * (i % 40), "abc"[i % 3]) for i in range(300)]))
    out = P.mix(spark, d, "")
    counts = Counter(map(str, out.collect()))
    sizes = Counter(map(str, d.collect()))
    assert out.columns == d.columns and set(counts) <= set(sizes) and all(n <= 3 * sizes[k] for k, n in counts.items())
    want = Counter({str(r): 0 for r in []})
    for r in mixing.mix_documents(d).collect():
        want[str(Row(**{c: r[c] for c in d.columns}))] += r["mix_copies"]
    assert counts == Counter({k: n for k, n in want.items() if n}) and P.mix(spark, documents([]), "").count() == 0


def test_tokenise(spark, documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = clashing(documents(odd + [(7, "Hello, world!  Twice", "s")] * 2))
    at, want = 0, []
    for i, t in sorted(((r.doc_id, r.text or "") for r in d.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.tokenise(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and P.tokenise(spark, documents([]), "").count() == 0


def test_whole_pipeline(spark):
    out = P.run(spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 100 and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(out[0].asDict())
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark", "mixing", "tokens"]


def test_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.ORACLE) <= set(names)
