"""Packing documents into sequences of tokens in the order of a space-filling curve.

Each document's tokens are hashed into a vector, projected to DIMENSIONS numbers and
given the Hilbert key of that point. Documents are range-sorted by key, so neighbours
along the curve are alike, and each range is cut into sequences of exactly `room`
tokens. What is left at a range's end is cut into sequences whose lengths are powers
of two, so nothing is padded.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm.bpe import byte_characters
from tracewell.llm.common import materialise, prepare, texts

DIMENSIONS, BITS, HASHED, SEED = 4, 8, 1024, 11
ROOM, END = 2048, 1
#: Bytes of tokens of a range of the curve, where there are more ranges than shuffle partitions.
RANGE_BYTES = 64 << 20
#: Tokens of a stored part of a document.
PART = 2048
PROJECTION = np.random.default_rng(SEED).normal(size=(HASHED, DIMENSIONS)).astype(np.float32)


#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """Ids of whole texts by a byte-level vocabulary in a tokenizers JSON file.

    Where the file's merges are in the order of their tokens' ids, which its byte-level
    kind has, the ids are found by rank with tiktoken, several times faster; other files,
    and texts with the vocabulary's special strings, go through the tokenizers library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranked = self.by_rank(spec)

    @staticmethod
    def by_rank(spec: dict) -> tiktoken.Encoding | None:
        model, step = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex") or model.get("end_of_word_suffix"):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes([byte[c] for c in token]): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(self.kind)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One tokenizer per worker process and path."""
    return Coder(path)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (n, d) with integer coordinates below 2**bits; d * bits is 62 at most."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of each level
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_point(ids: np.ndarray) -> np.ndarray:
    """DIMENSIONS coordinates below 2**BITS of a document's tokens: square roots of hashed counts, scaled to length 1 and projected."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    v = np.sqrt(np.bincount(hashed, minlength=HASHED)).astype(np.float32)
    p = v @ PROJECTION / max(1e-9, float(np.sqrt((v * v).sum())))
    return np.clip((np.tanh(p / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """(id, key long, n long, start long, same long, ids binary): each document's tokens, the end token last, in parts of PART, and its place on the curve; n counts all its tokens, start those before the part, same is a hash of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        last = np.array([end], code.kind)
        for batch in batches:
            ids = [np.concatenate([code.encode(t), last]) for t in texts(batch)]
            keys = hilbert_keys(np.array([document_point(i) for i in ids]).reshape(-1, DIMENSIONS))
            owner, start = (np.array(x, np.int64) for x in zip(*((k, a) for k, i in enumerate(ids) for a in range(0, len(i), PART)), strict=True)) if ids else (np.zeros(0, np.int64),) * 2
            n = np.array([len(i) for i in ids], np.int64)
            same = np.array([int.from_bytes(hashlib.blake2b(i.tobytes(), digest_size=8).digest(), "little", signed=True) for i in ids], np.int64)
            parts = pa.array([ids[k][a : a + PART].tobytes() for k, a in zip(owner, start, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys[owner]), pa.array(n[owner]), pa.array(start), pa.array(same[owner]), parts], names=["id", "key", "n", "start", "same", "ids"])

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, key long, n long, start long, same long, ids binary")


class Sequences:
    """Cuts a stream of documents into sequences; add() and close() give finished pieces."""

    def __init__(self, room: int, first: int):
        self.room, self.next, self.fill = room, first, 0
        self.open: list[tuple[object, int, np.ndarray, int, int]] = []

    def add(self, doc_id: object, ids: np.ndarray, before: int, whole: int, same: int) -> Iterator[tuple]:
        """Takes a part of a document of `whole` tokens, of which `before` lie ahead of the part; parts of one text that follow each other are joined."""
        start = 0
        while start < len(ids):
            part = ids[start : start + self.room - self.fill]
            last = self.open[-1] if self.open else None
            if last and last[0] == doc_id and last[4] == same and last[1] + len(last[2]) == before + start:
                self.open[-1] = (doc_id, last[1], np.concatenate([last[2], part]), whole, same)
            else:
                self.open.append((doc_id, before + start, part, whole, same))
            start += len(part)
            self.fill += len(part)
            if self.fill == self.room:
                yield from self.finish(self.room)

    def finish(self, size: int) -> Iterator[tuple]:
        """The first `size` open tokens as one sequence."""
        offset, rest = 0, []
        for doc_id, start, part, n, same in self.open:
            own, more = part[: size - offset], part[size - offset :]
            if len(own):
                yield doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), n, self.next, offset
            if len(more):
                rest.append((doc_id, start + len(own), more, n, same))
            offset += len(own)
        self.open, self.fill, self.next = rest, self.fill - size, self.next + 1

    def close(self) -> Iterator[tuple]:
        """What is open, in sequences of powers of two, the longest first."""
        while self.fill:
            yield from self.finish(1 << (self.fill.bit_length() - 1))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, all long): one row for each piece.

    A document is its text's tokens and the token `end`; null and empty texts are that
    token alone. Every token lies in exactly one piece. Sequences have `room` tokens;
    those at the end of a range have powers of two. Equal texts lie next to each other,
    spread over ranges by a hash of their ids where there are many. Repeated rows are
    packed as often as they occur, null ids too; an empty table gives no rows; other
    columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    known = materialise(tokenized(docs, path, id_col, text_col, end), "tokens")
    kind = known.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = coder(path).kind
        cut = Sequences(room, TaskContext.get().partitionId() << 32)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7))], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            rows = [piece for doc_id, ids, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True) for piece in cut.add(doc_id, np.frombuffer(ids, stored), *place)]
            yield table(rows)
        if cut.fill:
            yield table(list(cut.close()))

    # the rank by hash spreads equal keys over ranges, whose number grows with the tokens;
    # ranges are balanced by rows, which have PART tokens at most
    total = known.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    order = ["key", "spread", "id", "same", "start"]
    ranged = known.withColumn("spread", F.xxhash64("id")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    packed = ranged.select("id", "ids", "start", "n", "same").mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    return packed.withColumnRenamed("id", id_col)
