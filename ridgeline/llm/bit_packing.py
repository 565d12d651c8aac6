"""Token ids in fixed-width bit-packed files.

Every id takes the least number of bits that the vocabulary needs. File layout, little-endian:

    magic | block | block | ... | footer | footer length (u64) | magic

Each block holds block_ids ids (the last one fewer) as 64-bit words: 64 ids fill exactly `bits`
words, so packing and unpacking are 64 vectorised shifts whatever the width. The footer is a numpy
archive with bits, block_ids, the byte offset of each block, the document ids (and which are null)
and the index of each document's first id. Any range of ids is read by seeking to its blocks.

Files are written by the tasks straight to the shared folder through pyarrow's file systems, under
a name of the attempt; only files of successful attempts enter the manifest.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import shared_dir, text_batches
from ridgeline.llm.pieces import ADJACENT, BLANK, check_byte_level, chunks

MAGIC = b"RLBITS01"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids below 2**bits as 64-bit words, 64 ids in `bits` words."""
    rows = -(-len(ids) // 64)
    wide = np.zeros(rows * 64, dtype=np.uint64)
    wide[: len(ids)] = ids
    wide = wide.reshape(rows, 64)
    out = np.zeros((rows, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= wide[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= wide[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    rows = -(-n // 64)
    words = np.frombuffer(data, dtype="<u8").reshape(rows, bits)
    out, mask = np.empty((rows, 64), dtype=np.uint64), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n].astype(np.uint32)


class PackedWriter:
    """Writes one file; add() takes the ids of one document after the other."""

    def __init__(self, path: str, bits: int, block_ids: int = BLOCK_IDS):
        system, at = fs.FileSystem.from_uri(path)
        self.out, self.bits, self.block_ids = system.open_output_stream(at), bits, block_ids
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting, self.n_ids = len(MAGIC), [], 0, 0
        self.offsets, self.doc_ids, self.starts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_ids += len(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._flush(self.n_waiting // self.block_ids)

    def _flush(self, blocks: int, rest: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint32)
        cut = [ids[i * self.block_ids : (i + 1) * self.block_ids] for i in range(blocks)]
        tail = ids[blocks * self.block_ids :]
        for block in [*cut, tail] if rest and len(tail) else cut:
            data = pack(block, self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [tail], len(tail)

    def close(self) -> None:
        self._flush(0, rest=True)
        footer = io.BytesIO()
        missing = np.array([x is None for x in self.doc_ids], dtype=bool)
        docs = np.array([x or 0 for x in self.doc_ids], dtype=np.int64)
        starts = np.array([*self.starts, self.n_ids], dtype=np.int64)
        np.savez(footer, bits=self.bits, block_ids=self.block_ids, offsets=np.array([*self.offsets, self.at], dtype=np.int64), docs=docs, missing=missing, starts=starts)
        self.out.write(footer.getvalue())
        self.out.write(np.array([len(footer.getvalue())], dtype="<u8").tobytes() + MAGIC)
        self.out.close()


class PackedFile:
    """Reads a file of PackedWriter; read() gives any range of ids."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a packed file, or not whole")
        n = int(np.frombuffer(tail[:8], dtype="<u8")[0])
        footer = np.load(io.BytesIO(self.file.read_at(n, size - 16 - n)))
        self.bits, self.block_ids = int(footer["bits"]), int(footer["block_ids"])
        self.offsets, self.docs, self.missing, self.starts = (footer[k] for k in ("offsets", "docs", "missing", "starts"))
        self.n_ids = int(self.starts[-1])

    def read(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // self.block_ids, (end - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        full = min((b + 1) * self.block_ids, self.n_ids) - a * self.block_ids
        return unpack(data, self.bits, full)[first - a * self.block_ids : end - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


class LibraryEncoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary.

    A text is cut before each single blank or line break that stands between two other characters, which
    no pretoken crosses. Every distinct piece goes to the library once, many joined in one call, and its
    ids are kept in one array; a batch of texts is then looked up piece by piece and gathered at once.
    The kept pieces are forgotten when there are more than PIECES of them, or IDS ids.
    """

    PIECES, IDS = 1_000_000, 16_000_000
    LONGEST = 64  # a longer piece is not kept
    JOINED = 500  # pieces in one text for the library

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_byte_level(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words seen before are kept here
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # of ids that begin with a blank or line break
        self.opens[[i for x, i in vocab.items() if x[0] in "ĠĊ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.n = 0
        self.first, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.ids, self.n_ids = np.zeros(1 << 14, dtype=np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def keys(text: str) -> list[str]:
        """The pieces of a text: the first after a tab, those after a blank without it, those after a line break with it."""
        if ADJACENT.search(text):
            first, *rest = BLANK.split(text)
            return ["\t" + first, *[x[1:] for x in rest]]
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\t" + out[0]
        return out

    @staticmethod
    def _piece(key: str) -> str:
        return key[1:] if key[:1] == "\t" else key if key[:1] == "\n" else " " + key

    def _learn(self, new: list[str]) -> None:
        """Give every new key a number and keep its ids."""
        plain, rest = [], []
        for key in new:
            body = key[1:] if key[:1] == "\n" else key
            # without white space and not at a text's head: these may be joined in any order
            (plain if key[:1] != "\t" and body.split() == [body] else rest).append(key)
        for i in range(0, len(plain), 40 * self.JOINED):
            groups = [plain[j : j + self.JOINED] for j in range(i, min(i + 40 * self.JOINED, len(plain)), self.JOINED)]
            for group, ids in zip(groups, self._encode(["".join(map(self._piece, g)) for g in groups]), strict=True):
                at = np.flatnonzero(self.opens[ids])
                if len(at) == len(group) and at[0] == 0:
                    self._keep(group, ids, np.diff(np.r_[at, len(ids)]))
                else:
                    rest += group
        for i in range(0, len(rest), self.JOINED):
            part = rest[i : i + self.JOINED]
            own = self._encode(list(map(self._piece, part)))
            self._keep(part, np.concatenate(own), np.fromiter(map(len, own), dtype=np.int64, count=len(own)))

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(keys) > len(self.first):
            self.first, self.size = (np.r_[x, np.zeros(len(x), dtype=np.int64)] for x in (self.first, self.size))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), dtype=np.uint32)]
        self.index.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.first[self.n : self.n + len(keys)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(keys)] = sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n += len(keys)
        self.n_ids += len(ids)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.keys(x) for x in texts]
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = set(map(flat.__getitem__, missing.tolist()))
            if self.n and (self.n + len(new) > self.PIECES or self.n_ids > self.IDS):
                self._forget()
                new, missing = set(flat), np.arange(len(flat))
            self._learn(list(new))
            at[missing] = np.fromiter(map(self.index.__getitem__, map(flat.__getitem__, missing.tolist())), dtype=np.int64, count=len(missing))
            for key in [k for k in new if len(k) > self.LONGEST]:
                del self.index[key]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.r_[0, ends][np.cumsum([0, *map(len, cut)])]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_packed(docs: DataFrame, tokenizer: str, end_id: int | None = 0, folder: str | None = None) -> str:
    """Encode docs(doc_id, text) into packed files in ascending doc_id order; returns the folder.

    The folder gets a manifest.json that lists the files in order with the ids before each. Null
    doc_ids come first; equal doc_ids stand in the order of their texts' hashes; a null text is
    empty; other columns are ignored. An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    system, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, task = encoder(tokenizer), None, TaskContext.get()
        bits = bits_for(own.tokenizer.get_vocab_size(with_added_tokens=True))
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bits"
        end = np.zeros(0, dtype=np.uint32) if end_id is None else np.array([end_id], dtype=np.uint32)
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())  # Python integers and None: exact whatever their size
            for texts in chunks(batch.column(1).to_pylist()):
                for encoded in own.encode_batch(texts):
                    out = out or PackedWriter(path, bits)
                    out.add(next(ids), np.concatenate([encoded, end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]})

    placed = (
        docs.select(F.col("doc_id").cast("long").alias("__doc"), F.coalesce("text", F.lit("")).alias("__text"))
        .withColumn("__tie", F.xxhash64("__text"))
        .repartitionByRange("__doc", "__tie")
        .sortWithinPartitions("__doc", "__tie")
        .select("__doc", "__text")
    )
    files = placed.mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect()  # a row a file
    start, listed = 0, []
    for f in sorted(files, key=lambda r: r["part"]):
        listed.append({"path": f["path"], "start": start, "n_docs": f["n_docs"], "n_ids": f["n_ids"]})
        start += f["n_ids"]
    with system.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps({"files": listed, "n_ids": start}).encode())
    return folder


def read_packed(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of write_packed()."""
    system, at = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{at}/manifest.json") as f:
        files = json.loads(f.read())["files"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, i = PackedFile(path), 0
                while i < len(own.docs):
                    # as many documents as about a million ids hold
                    j = max(i + 1, int(np.searchsorted(own.starts, own.starts[i] + 1_000_000, side="right")) - 1)
                    j = min(j, len(own.docs))
                    base = int(own.starts[i])
                    ids = own.read(base, int(own.starts[j])).astype("<u4")
                    crcs = [zlib.crc32(ids[int(own.starts[k]) - base : int(own.starts[k + 1]) - base].tobytes()) for k in range(i, j)]
                    columns = [pa.array(own.docs[i:j], mask=own.missing[i:j]), own.starts[i:j] + start, np.diff(own.starts[i : j + 1]), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return rows.repartition(len(files)).mapInArrow(read, schema)
