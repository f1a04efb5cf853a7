"""Token files, WARC and SimHash: exact round trips and brute force."""

import io
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import simhash, tokens, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 2), (1000, 50257), (1001, 2**32 - 1)):
        ids = rng.integers(0, top, n).astype("<u4")
        assert np.array_equal(tokens.ids_of(tokens.planes_of(ids, kind), n, kind), ids)
    out = io.BytesIO()
    w = tokens.Writer(out, kind, block=64)
    docs = [(i if i else None, rng.integers(0, 60000, rng.integers(0, 200)).astype("<u4")) for i in range(50)]
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    r = tokens.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert all(a == b and np.array_equal(x, y) for (a, x), (b, y) in zip(docs, r.documents(), strict=True))
    with pytest.raises(ValueError):
        tokens.Reader(io.BytesIO(out.getvalue()[:-3]), len(out.getvalue()) - 3)


def test_chunks_encode_as_the_library_does():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "the", "Été", "1", "23", ".", ",", "!?", "'s", "'", "#", "\x1c", "\x85", "　", " ", "²", "日本", "é", "<|endoftext|>", "_", "-", "ª", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [""]
    got = tokens.Encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, documents, odd, kind):
    rows = odd + [(9, "Hello, world\n\nagain", "s"), (7, "x", "s")]
    folder = tokens.write_tokens(documents(rows).withColumn("tie", F.lit(1)), PATH, kind=kind, block=1000, file_ids=2000)
    out = sorted(tokens.read_tokens(spark, folder, ids=True).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(PATH), 0
    want = sorted((i if i is not None else -1, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x, _ in rows)
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in out) == want
    assert [r.doc_id if r.doc_id is not None else -1 for r in out] == [i for i, _ in want]
    assert tokens.read_tokens(spark, tokens.write_tokens(documents([]), PATH)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "u", "<p>é</p>"), (6, "u", "solo\r\n\r\n"), (6, "u", "solo\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    folder = warc.write_archives(pages, file_bytes=500)
    records = warc.read_records(spark, folder)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records)
    assert captures.count() == len(rows) and all(len(r.requests) == len(r.metadata) == 1 for r in captures.collect())
    full = {r.p: r.b for r in captures.where("response.type = 'response'").selectExpr("metadata[0].fields['page-id'] AS p", "response.payload AS b").collect()}
    assert bytes(full["2"]).decode() == "<p>é</p>" and len(full["5"]) == 200_000 and bytes(full["6"]) == b"solo\r\n\r\n"
    got = sorted(map(str, warc.resolve(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = i is None or i < best[h]
        want.append((i, len(h.encode()), warc.digest(h.encode()), "revisit" if revisit else "response", best[h] if revisit else None))
    assert sorted(tuple(r) for r in warc.resolve(captures).collect() and [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.resolve(captures).collect()]) == sorted((a or 0, b, c, d, e or 0) for a, b, c, d, e in want), got
    lone = records.where("type <> 'request' OR target_uri IS NULL").where("type = 'metadata'")
    assert warc.assemble(lone).where("response IS NULL").count() == len(rows)
    assert warc.resolve(warc.assemble(warc.read_records(spark, warc.write_archives(pages.where("false"))))).count() == 0
    member = warc.member(b"a") + warc.member(b"b" * 5000)
    assert [d for _, d in warc.members(io.BytesIO(member), 7)] == [b"a", b"b" * 5000]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(member[:-4]), 7))


def brute_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash_against_brute_force(documents, odd):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 200))] for _ in range(60)]
    rows = odd + [(100 + i, "É" + " ".join(w), "s") for i, w in enumerate(base)]
    for i in range(120):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = "Changed"
        rows.append((1000 + i, "É" + " ".join(w), "s"))
    got = simhash.near_duplicates(documents(rows).withColumn("fp", F.lit(1)), block=8).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                x, y = label[a], label[b]
                label = [min(x, y) if z in (x, y) else z for z in label]
    least = {}
    for (i, _), c in zip(fps, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(c))) for (i, f), c in zip(fps, label, strict=True))
    assert sorted((str(r.doc_id), bytes(r.fp).hex(), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_pigeonhole_plans_miss_nothing():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, (300, 1)).astype(np.uint64)
    for distance in (0, 3, 7):
        for n in (300, 10**6, 10**9):
            parts = simhash.plan(sample, n, distance)
            assert sum(t + 1 for _, t in parts) > distance
            assert len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(100)], "a binary, b binary")
    assert {bytes(r.root) for r in simhash.components(edges).collect()} == {b"\x00"}
