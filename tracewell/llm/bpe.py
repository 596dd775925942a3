"""BPE encoding and decoding with forced boundaries.

Two bytes that are never neighbours inside any vocabulary token can never end up
in one token, whatever is merged. Such pairs mark certain cuts: a word is cut at
them, the fragments are encoded independently, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tracewell.llm.common import Remembered, prepare, texts

#: Characters with the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_characters() -> list[str]:
    """Character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary with word ends, as in a tokenizers JSON file.

    encode() gives the ids that the tokenizers library gives without its added special
    tokens around the text; decode() its text for ids, special tokens included. Special
    tokens' strings in a text are those tokens. An empty text has no ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.chars = byte_characters()
        self.joined = {t[i : i + 2] for x in self.vocab for t in [x.removesuffix(self.end)] for i in range(len(t) - 1)}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.blank = regex.compile(f"[{SPACE}]+").split
        library = Tokenizer.from_file(path)
        self.normal, self.cut_up = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inside = BPE(self.vocab, merges, cache_capacity=0)
        self.ending = BPE(self.vocab, merges, cache_capacity=0, end_of_word_suffix=self.end) if self.end else self.inside
        self.words_known = Remembered(self.word)
        self.words_described = Remembered(self.described_word)
        self.pieces_known = Remembered(self.piece)
        self.separators = {*"\x1c\x1d\x1e\x1f"}

    def cuts(self, piece: str) -> list[str]:
        """piece cut at every pair of neighbours that no vocabulary token holds."""
        at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.joined]
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)], strict=True)]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece in the vocabulary's characters: its fragments' ids one after the other; only the last fragment has the word's end."""
        *inner, last = self.cuts(piece)
        ids = [t.id for part in inner for t in self.inside.tokenize(part)]
        ids += [t.id for t in self.ending.tokenize(last)]
        return ids

    def word(self, word: str) -> list[int]:
        """Ids of a stretch of text without white space.

        What is ASCII is lower-cased and cut here; in other words the library's own
        normaliser and word pattern decide, whose Unicode version may differ from Python's.
        """
        if word.isascii():
            lowered = word.lower()
            if lowered.isalpha():
                return self.pieces_known(lowered)
            pieces = self.pieces(lowered)
            if not word.isprintable():
                pieces = ["".join([self.chars[b] for b in p.encode()]) for p in pieces]
        else:
            pieces = [p for p, _ in self.cut_up(self.normal(word))]
        ids: list[int] = []
        for piece in pieces:
            ids += self.pieces_known(piece)
        return ids

    def stretches(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """text as (special token's id, []) and (None, words without white space), in order."""
        for k, part in enumerate(self.split_special(text) if self.split_special and "<" in text else [text]):
            if k % 2:
                yield self.special[part], []
            else:
                yield None, part.split() if part.isprintable() or not self.separators.intersection(part) else [w for w in self.blank(part) if w]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for special, words in self.stretches(text):
            if special is not None:
                ids.append(special)
            for found in self.words_known.all(words):
                ids += found
        return ids

    def described_word(self, word: str) -> tuple[int, str, str]:
        ids = self.words_known.function(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def described(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their decimal digits joined by spaces, and the text they decode to.

        Ids of separate words never influence each other, so both strings are joined from the words' own.
        """
        rows: list[tuple[int, str, str]] = []
        for special, words in self.stretches(text):
            if special is not None:
                rows.append((1, str(special), self.decode([special])))
            rows += self.words_described.all(words)
        return sum([r[0] for r in rows]), " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def bpe(path: str) -> ForcedBoundaryBPE:
    """One vocabulary per worker process and path."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of docs.

    Null and empty texts give an empty array; repeated rows give repeated rows; an
    empty table gives none. Other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(path).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) for t in texts(batch)], pa.list_(pa.int32()))], names=["id", "ids"])

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_sha256 string, decoded_sha256 string): each text is encoded and its ids decoded.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded
    text in UTF-8. Null texts count as empty; every input row gives one row.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in texts(batch):
                count, digits, decoded = coder.described(text)
                n.append(count)
                ids_sha.append(hashlib.sha256(digits.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
