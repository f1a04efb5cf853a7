"""Token-id files: bit-plane shuffling.

Ids are cut into blocks of a fixed number. A block is transposed into planes, one for each bit (``bit``)
or byte (``byte``) of the ids, and each plane is compressed by itself with zstandard; planes of zeros are
not stored. A file is

    magic "LKSPLN1\\n" | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes) | magic

where the index is zstandard-compressed JSON: the block size, for each block its ids and the lengths of its
planes, and for each document its id and number of tokens. Blocks run across documents, so a reader seeks to
any token by block number.

Documents are range-partitioned by id (equal ids are parted further by text and by place, so that no id is one task's),
sorted, encoded, and written by each task into files of its own, under names that no other attempt uses.
Only files named in the manifest, a Parquet table in the same folder, count; what a lost attempt left is
never read.

Encoding: byte-level BPE never merges across the pre-tokenizer's pieces. No piece goes on over the start of a
run of white space, nor from a letter to a mark like a full stop. So texts are cut there, and the library
encodes each distinct chunk once; texts with an added token's string are encoded whole.

Edge cases: a null text is an empty one (only the end id); documents of null id come first; repeated ids are
separate rows, ordered by text; an empty table makes no file and an empty result; other columns aren't
looked at.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm._common import alone, forget, materialize, scratch_path, small_batches

MAGIC = b"LKSPLN1\n"
#: Ids in a block.
BLOCK = 1 << 16
#: A task goes on with another file after so many ids, or so many documents: what a file's index lists.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 18
#: Bytes of chunks and their ids that a worker remembers, objects' heads included: the first that it meets.
REMEMBERED = 192 << 20
# white space as the tokenizer's pattern has it, which differs from Python's
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf"[{_W}]*[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?])|[{_W}]*[^{_W}]+|[{_W}]+")


# ---------------------------------------------------------------- planes


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of uint32 ids, least bit or byte first; empty where all zero."""
    by = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = [np.packbits((by[:, i // 8] >> (i % 8)) & 1, bitorder="little") if (by[:, i // 8]).any() else np.zeros(0, np.uint8) for i in range(32)]
    else:
        rows = [by[:, i] for i in range(4)]
    return [r.tobytes() if r.any() else b"" for r in rows]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    by = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(planes):
        if not p:
            continue
        if kind == "bit":
            by[:, i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (i % 8)
        else:
            by[:, i] = np.frombuffer(p, np.uint8)
    return by.view("<u4").reshape(-1)


# ---------------------------------------------------------------- files


class Writer:
    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.blocks: list[list] = []
        self.docs: list[list] = []
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids)])
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            have = np.concatenate(self.held)
            full = len(have) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(have[i : i + self.block])
            self.held, self.n_held = [have[full:].copy()], len(have) - full

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.pack(p) if p else b"" for p in planes_of(ids, self.kind)]
        for p in packed:
            self.out.write(p)
        self.blocks.append([len(ids), [len(p) for p in packed]])

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        index = self.pack(json.dumps({"kind": self.kind, "block": self.block, "blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(index)
        self.out.write(struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """source: a seekable binary file of ``size`` bytes."""

    def __init__(self, source, size: int):
        import zstandard

        self.source = source
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        (n,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 8 - len(MAGIC) - n)
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.index = json.loads(self.unpack(source.read(n)))
        at, self.offsets = len(MAGIC), []
        for _, lengths in self.index["blocks"]:
            self.offsets.append(at)
            at += sum(lengths)

    def read_block(self, k: int) -> np.ndarray:
        n, lengths = self.index["blocks"][k]
        self.source.seek(self.offsets[k])
        planes = [self.unpack(self.source.read(x)) if x else b"" for x in lengths]
        return ids_of(planes, n, self.index["kind"])

    def documents(self):
        """(doc_id, ids) in the file's order; holds one document and one block."""
        k, rest = 0, np.zeros(0, np.uint32)
        for doc_id, n in self.index["docs"]:
            parts, need = [], n
            while need > len(rest):
                parts.append(rest)
                need -= len(rest)
                rest = self.read_block(k)
                k += 1
            parts.append(rest[:need])
            rest = rest[need:]
            yield doc_id, np.concatenate(parts)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- encoding

_encoders: dict[tuple, Encoder] = {}
forget["tokens"] = _encoders.clear


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # cutting at blanks is right for this pre-tokenizer only
        self.cut = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []))) if spec.get("added_tokens") else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        whole = [i for i, t in enumerate(texts) if not self.cut or (self.added and self.added.search(t))]
        out: dict[int, bytes] = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        get = self.known.get
        found, missing = {}, {}
        for i, t in enumerate(texts):
            if i not in out:
                chunks = _CHUNK.findall(t)
                found[i] = ids = list(map(get, chunks))
                if None in ids:
                    missing[i] = [(k, chunks[k]) for k, x in enumerate(ids) if x is None]
        new = list({c for ks in missing.values() for _, c in ks})
        fresh: dict[str, bytes] = {}
        for k in range(0, len(new), 20_000):
            fresh.update(zip(new[k : k + 20_000], self._whole(new[k : k + 20_000]), strict=True))
        for i, ks in missing.items():
            for k, c in ks:
                found[i][k] = fresh[c]
        if self.held < REMEMBERED:
            self.known.update(fresh)
            self.held += sum(200 + 2 * len(c) + len(x) for c, x in fresh.items())
        for i, ids in found.items():
            out[i] = b"".join(ids)
        return [out[i] for i in range(len(texts))]


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]


# ---------------------------------------------------------------- the operator


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, kind: str = "byte", block: int = BLOCK, end_id: int | None = 0, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS, special_as_text: bool = False) -> str:
    """Encode docs (doc_id, text) into files under ``folder`` and return it. Its manifest is folder/manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "tokens")
    ending = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        alone("tokens")
        enc, part, seq = encoder(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out = writer = name = None
        done: list[tuple] = []

        def close():
            nonlocal writer, seq
            writer.close()
            out.close()
            done.append((part, seq, name, writer.n_ids, len(writer.docs)))
            writer, seq = None, seq + 1

        for b in batches:
            for i in range(0, b.num_rows, 200):
                some = b.slice(i, 200)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(texts), strict=True):
                    if writer is None:
                        name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.planes"
                        out = store.open_output_stream(f"{root}/{name}")
                        writer = Writer(out, kind, block)
                    writer.add(doc_id, np.frombuffer(ids + ending, "<u4"))
                    if writer.n_ids >= file_ids or len(writer.docs) >= file_docs:
                        close()
        if writer is not None:
            close()
        cols = list(zip(*done)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["part", "seq", "name", "n_ids", "n_docs"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows equal in both are parted by where they were read
    d = d.withColumn("tie", F.xxhash64("text")).withColumn("read", F.monotonically_increasing_id())
    d = d.repartitionByRange("doc_id", "tie", "read").sortWithinPartitions("doc_id", "tie", "text")
    manifest = d.select("doc_id", "text").mapInArrow(run, "part int, seq int, name string, n_ids long, n_docs long")
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; with ``ids`` also ids (array of int).

    One task reads a file or several, a block at a time.
    """
    files = spark.read.schema("part int, seq int, name string, n_ids long, n_docs long").parquet(f"{folder}/manifest").where("n_docs > 0")
    ahead = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    files = materialize(files.withColumn("base", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0))).select("name", "base"), "token-files")

    def run(batches):
        import pyarrow as pa

        store, root = _open(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                with store.open_input_file(path) as f:
                    start, rows = base, []
                    for doc_id, x in Reader(f, f.size()).documents():
                        rows.append((doc_id, start, len(x), zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()), x.tolist() if ids else None))
                        start += len(x)
                        if len(rows) == 1000:
                            yield batch(pa, rows)
                            rows = []
                    if rows:
                        yield batch(pa, rows)

    def batch(pa, rows):
        a, b, c, d, e = zip(*rows)
        cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())] + ([pa.array(e, pa.list_(pa.int32()))] if ids else [])
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    n = max(1, files.count())
    return files.repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
