"""Alignment of the tokens of two vocabularies over the same bytes.

A text is cut into words before every space between two characters that are no white
space. No token of either vocabulary reaches over such a cut, so each word is aligned
for itself and remembered. The ends of both vocabularies' tokens are marked in packed
bitsets over the bytes of all new words of a batch; the AND of both is the set of shared
cuts, and the number of ends up to each cut, found by popcounts, turns it into ranges of
tokens. The tokens between two shared cuts are a group; the last token of each side
of a group are linked.

Two linked tokens end at the same byte of the same text, so the bytes of one are a
suffix of the other's: the pairs that can ever be linked follow from the vocabularies
alone. They are numbered, a text's links are stored as these numbers, and counts over
the corpus are arrays of that fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm.bpe import byte_characters
from tracewell.llm.common import materialise, passing_tables, prepare, texts
from tracewell.llm.packing import Coder

#: A space before which a text is cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are cut into words at once; words of more than LONG characters aren't remembered.
CHUNK, LONG = 1 << 20, 64
#: Words of one generation of a worker's memory; it keeps two.
KEPT = 250_000
LITTLE = np.dtype("<u8")


#: What is known of a word: its part of a text's description, the numbers of its linked pairs, tokens of A, tokens of B.
Word = tuple[str, bytes, int, int]


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Packed bits, the last byte of each token set; ends are the bytes up to and with it."""
    marks = np.zeros(-(-size // 64) * 64, np.uint8)
    marks[ends - 1] = 1
    return np.packbits(marks, bitorder="little").view(LITTLE)


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    held = bits[at >> 6] & (~np.uint64(0) >> (63 - (at & 63)).astype(np.uint64))
    return before[at >> 6] + np.bitwise_count(held)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last byte of each group, tokens of A up to it, tokens of B up to it)."""
    a, b = bitset(ends_a, size), bitset(ends_b, size)
    at = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return at, rank(a, at), rank(b, at)


class Aligner:
    """Tokens of a byte-level vocabulary (A, a tokenizers JSON file) and of a piece vocabulary (B, a sentencepiece model) over a space and a text."""

    def __init__(self, path_a: str, path_b: str):
        code = Coder(path_a)
        plain = Tokenizer.from_file(path_a)
        plain.encode_special_tokens = True
        plain.no_truncation()
        plain.no_padding()
        self.encode_a = code.ranked.encode_ordinary if code.ranked else lambda text: plain.encode(text, add_special_tokens=False).ids
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = plain.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in byte for c in token):
                self.bytes_a[i] = bytes([byte[c] for c in token])
        sp = self.pieces
        self.bytes_b = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size())]
        if any(" " in piece.lstrip(" ") for piece in (sp.id_to_piece(i).replace("▁", " ") for i in range(sp.vocab_size()))):
            raise ValueError(f"{path_b} has pieces that hold a space after another character, so texts can't be cut before spaces")
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = self.possible_pairs()
        digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.inner, self.bar, self.end = (np.array([d + mark for d in digits], object) for mark in ",|;")
        self.young: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def possible_pairs(self) -> np.ndarray:
        """a << 32 | b, sorted, of all tokens of which one's bytes are a suffix of the other's: what can end together, whatever the text."""
        ids_a, ids_b = ({}, {})
        for ids, tokens in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            for i, token in enumerate(tokens):
                if token:
                    ids.setdefault(token, []).append(i)
        found = {a << 32 | b for a, token in enumerate(self.bytes_a) for k in range(len(token)) for b in ids_b.get(token[k:], ())}
        found |= {a << 32 | b for b, token in enumerate(self.bytes_b) for k in range(len(token)) for a in ids_a.get(token[k:], ())}
        return np.array(sorted(found), np.int64)

    def align(self, words: list[str]) -> list[Word | None]:
        """Each word with a space before it; None where a vocabulary's tokens don't spell it.

        All words but a single one begin and end with characters that are no white space,
        so joined by spaces they are cut as they are alone.
        """
        text = " " + " ".join(words)
        raw = text.encode()
        a, b = self.encode_a(text), self.pieces.encode(text[1:])
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            half = len(words) // 2
            return self.align(words[:half]) + self.align(words[half:]) if half else [None]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at, upto_a, upto_b = shared_cuts(ends_a, ends_b, len(raw))
        links = np.searchsorted(self.pairs, a[upto_a - 1] << 32 | b[upto_b - 1]).astype("<u4").tobytes()
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[upto_a - 1], last_b[upto_b - 1] = True, True
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = np.where(last_a, self.bar[a], self.inner[a])
        shown[np.arange(len(b)) + np.repeat(upto_a, size_b)] = np.where(last_b, self.end[b], self.inner[b])
        shown = shown.tolist()
        bytes_of = [len(w) for w in words] if text.isascii() else [len(w.encode()) for w in words]
        groups = np.searchsorted(at, np.cumsum(np.array(bytes_of) + 1) - 1, "right")
        edges = (np.concatenate([[0], x]).tolist() for x in (groups, upto_a[groups - 1], upto_b[groups - 1]))
        bounds = list(zip(*edges, strict=True))
        return [("".join(shown[p + q : x + y])[:-1], links[4 * g : 4 * h], x - p, y - q) for (g, p, q), (h, x, y) in zip(bounds, bounds[1:], strict=False)]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, those of about CHUNK characters at once."""
        start = 0
        while start < len(text):
            cut = CUT.search(text, min(len(text), start + CHUNK))
            end = cut.start() if cut else len(text)
            yield CUT.split(text[start:end])
            start = end + 1

    def learn(self, words: set[str]) -> dict[str, Word | None]:
        """Remembers the short ones of these words and returns what is known of the long ones."""
        if len(self.young) >= KEPT:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        ragged = [w for w in new if not w or w[0].isspace() or w[-1].isspace()]
        clean = list(set(new).difference(ragged)) if ragged else new
        found = dict(zip(clean, self.align(clean), strict=True)) if clean else {}
        found |= {w: self.align([w])[0] for w in ragged}
        young.update({w: x for w, x in found.items() if len(w) <= LONG})
        return {w: x for w, x in found.items() if len(w) > LONG}

    def describe(self, batch: list[str]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """(tokens of A, of B, groups, digest of the groups, numbers of the linked pairs) of each text; zeros and empty ones where it has no tokens.

        Texts that together have up to CHUNK characters learn their words at once.
        """
        start = 0
        while start < len(batch):
            end, size = start + 1, len(batch[start])
            while end < len(batch) and size + len(batch[end]) <= CHUNK:
                size += len(batch[end])
                end += 1
            if size > CHUNK:
                yield self.described(self.words(batch[start]))
            else:
                words = [CUT.split(text) if text else [] for text in batch[start:end]]
                long = self.learn(set().union(*words))
                for w in words:
                    yield self.described([w] if w else [], long)
            start = end

    def described(self, parts: Iterable[list[str]], long: dict[str, Word | None] | None = None) -> tuple[int, int, int, str, bytes]:
        """One text in parts; where `long` is given its words are learned already."""
        digest, n_a, n_b, links = hashlib.sha256(), 0, 0, []
        for words in parts:
            more = self.learn(set(words)) if long is None else long
            try:
                known = [self.young[w] for w in words] if not more else [self.young[w] if len(w) <= LONG else more[w] for w in words]
                groups, pairs, a, b = zip(*known, strict=True)
            except TypeError:  # a word that isn't spelt
                return 0, 0, 0, "", b""
            digest.update(((";" if links else "") + ";".join(groups)).encode())
            n_a, n_b = n_a + sum(a), n_b + sum(b)
            links.append(b"".join(pairs))
        links = b"".join(links)
        return (n_a, n_b, len(links) // 4, digest.hexdigest(), links) if links else (0, 0, 0, "", b"")


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per process and pair of files."""
    return Aligner(path_a, path_b)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups long, groups_sha256 string, links binary) of every text; links are four bytes each, numbers of Aligner.pairs.

    Texts that are null, empty, or that a vocabulary doesn't spell have zeros and empty
    values. Repeated rows give repeated rows, null ids stay, an empty table gives none;
    other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for batch in batches:
            n_a, n_b, n_groups, digest, links = zip(*known.describe(texts(batch)), strict=True) if batch.num_rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest, pa.string()), pa.array(links, pa.binary())], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary").withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(pair int, n long): how often each pair is linked in all of aligned; each task adds up an array of n_pairs numbers, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for links in batch.column(0):
                np.add.at(total, np.frombuffer(links.as_buffer(), "<u4"), 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_table(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a int, b int, n long, best boolean) of every linked pair of token ids; best marks the highest n of its b, ties included."""
    known = aligner(path_a, path_b)
    n, best = counted(aligned, known.pairs)
    held = np.flatnonzero(n)
    rows = pa.table({"a": pa.array(known.pairs[held] >> 32, pa.int32()), "b": pa.array(known.pairs[held] & 0xFFFFFFFF, pa.int32()), "n": n[held], "best": best[held]})
    return aligned.sparkSession.createDataFrame(rows.to_pandas(), "a int, b int, n long, best boolean")


def counted(aligned: DataFrame, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, best) of each possible pair; the counts that come to the driver are as many as the vocabularies have possible pairs, not as the corpus has links."""
    found = link_counts(aligned, len(pairs)).toArrow()
    n = np.zeros(len(pairs), np.int64)
    n[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    b = pairs & 0xFFFFFFFF
    most = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(most, b, n)
    return n, (n > 0) & (n == most[b])


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string) of every text; odd rows as in align_documents().

    n_best is how many of a text's links are the commonest of their B id in the corpus,
    count_sum the sum of its links' counts there.
    """
    with passing_tables(prepare(docs.sparkSession)):
        aligned = materialise(align_documents(docs, path_a, path_b, id_col, text_col), "aligned")
        n, best = counted(aligned.select("links"), aligner(path_a, path_b).pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                links = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(batch.num_columns - 1)]
                found = [pa.array([int(x) for x in column], pa.int64()) for column in ([len(x) for x in links], [best[x].sum() for x in links], [n[x].sum() for x in links])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *found, batch.column(4)], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        kind = aligned.schema[id_col].dataType.simpleString()
        out = aligned.withColumnRenamed(id_col, "id").mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return materialise(out.withColumnRenamed("id", id_col), "alignment", outside=True)
