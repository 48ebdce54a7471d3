"""Alignment of two tokenizers' tokens over the same bytes.

Each tokenizer's token ends are bits of a packed bitset, one bit a byte of text. The bits that both
sets have are the shared cuts: between two of them lies a group of tokens of either side that cover
the same bytes. Ranks (popcounts of the words before a cut, and of the cut's own word up to it) turn
a cut into the number of tokens on either side that end there or before. A link is an occurrence of
a token of each side whose byte ranges end together, so every cut is the end of exactly one.

Of two tokens that end together one's bytes are a suffix of the other's. The vocabularies alone
therefore bound how many different id pairs can ever be linked (under a million for two usual
vocabularies): their counts over a corpus of any size fit an array of that length.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written

#: Code points of texts that are aligned at a time (or one text), and chunks of text that a worker remembers, but for those of one run (about 60 MB).
RUN, MEMO = 1 << 20, 200_000
#: Where both tokenizers start anew whatever stands before: one space between two other characters. Chunks between recur.
SEAM = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_aligners: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones of Latin-1 for
    themselves, the others in their order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def bitset(places: np.ndarray, size: int) -> np.ndarray:
    """A packed set of places below ``size``, the lowest bit of a word first."""
    marks = np.zeros(-(-size // 64) * 64, bool)
    marks[places] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def members(bits: np.ndarray) -> np.ndarray:
    """The places in a packed set, ascending (select)."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many members of a packed set are at or before each place."""
    ones = np.bitwise_count(bits).astype(np.int64)
    word = places >> 6
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (places & 63).astype(np.uint64))
    return (np.cumsum(ones) - ones)[word] + np.bitwise_count(bits[word] & upto)


@dataclass
class Run:
    """Aligned texts: ids of both sides, the byte offset behind each shared cut, how many tokens of
    either side end there or before, and how many cuts, bytes each text has."""

    a: np.ndarray
    b: np.ndarray
    cuts: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    text_cuts: np.ndarray


class Aligner:
    """A byte-level tokenizer file (side a, reads a space and the text) and a piece model with byte
    fallback (side b, adds that space itself)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.side_a = Tokenizer.from_file(a_path)
        self.side_a.encode_special_tokens = True
        self.side_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocabulary = byte_alphabet(), self.side_a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.side_b.get_piece_size()):
            piece = self.side_b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.side_b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.pairs = self._pairs()
        self.best_of = (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self._decimal: list[str] = []
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.old = self.memo

    def _pairs(self) -> np.ndarray:
        """All pairs (a << 32 | b, ascending) of which one's bytes are a suffix of the other's."""
        by_a, by_b = defaultdict(list), defaultdict(list)
        for ids, tokens in ((by_a, self.a_bytes), (by_b, self.b_bytes)):
            for i, token in enumerate(tokens):
                ids[token].append(i)
        found = {a << 32 | b for a, x in enumerate(self.a_bytes) for k in range(len(x)) for b in by_b.get(x[k:], ())}
        found |= {a << 32 | b for b, x in enumerate(self.b_bytes) for k in range(len(x)) for a in by_a.get(x[k:], ())}
        return np.array(sorted(found), np.uint64)

    def _remember(self, chunks: set[str]) -> None:
        """Ids of both sides for each chunk; None where their bytes aren't a space and the chunk. What was
        met since the memo last filled up, and what it held then, is known."""
        if len(self.memo) > MEMO // 2:
            self.old, self.memo = self.memo, {}
        missing = []
        for chunk in chunks.difference(self.memo):
            if chunk in self.old:
                self.memo[chunk] = self.old[chunk]
            else:
                missing.append(chunk)
        sides = self.side_a.encode_batch([" " + c for c in missing], add_special_tokens=False), self.side_b.encode(missing)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for chunk, a, b in zip(missing, [x.ids for x in sides[0]], sides[1]):
            whole = b" " + chunk.encode()
            same = b"".join(map(a_bytes, a)) == whole and b"".join(map(b_bytes, b)) == whole
            self.memo[chunk] = (struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)) if same else None

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text, or None where there is no text or their bytes aren't a space
        and the text."""
        chunks = [SEAM.split(t) if t else [] for t in texts]
        self._remember({c for x in chunks for c in x})
        out = []
        for x in chunks:
            known = list(map(self.memo.__getitem__, x))
            out.append(tuple(np.frombuffer(b"".join([k[side] for k in known]), "<u4") for side in (0, 1)) if x and None not in known else None)
        return out

    def align(self, encoded: list[tuple[np.ndarray, np.ndarray]]) -> Run:
        """Texts side by side: each ends at a shared cut, so no group crosses from one to the next."""
        a, b = (np.concatenate([x[side] for x in encoded]).astype(np.int64) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        size = int(a_ends[-1])
        a_bits, b_bits = bitset(a_ends - 1, size), bitset(b_ends - 1, size)
        cuts = members(a_bits & b_bits)
        a_to, b_to = ranks(a_bits, cuts), ranks(b_bits, cuts)
        return Run(a, b, cuts + 1, a_to, b_to, np.searchsorted(a_to, np.cumsum([len(x[0]) for x in encoded]), "left") + 1)

    def group_texts(self, run: Run) -> Iterator[str]:
        """For each text its groups, ``a1,a2|b1;a3|b2,b3``."""
        if not self._decimal:
            self._decimal = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]
        a_n, b_n = np.diff(run.a_to, prepend=0), np.diff(run.b_to, prepend=0)
        tokens = np.empty(len(run.a) + len(run.b), np.int64)
        mark_a, mark_b = np.zeros(len(run.a), np.int64), np.zeros(len(run.b), np.int64)
        mark_a[run.a_to - 1], mark_b[run.b_to - 1] = 1, 2
        tokens[np.arange(len(run.a)) + np.repeat(run.b_to - b_n, a_n)] = 3 * run.a + mark_a
        tokens[np.arange(len(run.b)) + np.repeat(run.a_to, b_n)] = 3 * run.b + mark_b
        at = 0
        for last in run.text_cuts - 1:
            to = int(run.a_to[last] + run.b_to[last])
            yield "".join(map(self._decimal.__getitem__, tokens[at:to].tolist()))[:-1]
            at = to

    def links(self, run: Run) -> np.ndarray:
        """The linked pair of each cut, as its place in ``pairs``."""
        return np.searchsorted(self.pairs, (run.a[run.a_to - 1] << 32 | run.b[run.b_to - 1]).astype(np.uint64)).astype(np.uint32)


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _runs(texts: list[str | None]) -> Iterator[list[int]]:
    run, size = [], 0
    for row, text in enumerate(texts):
        if run and size + len(text or "") > RUN:
            yield run
            run, size = [], 0
        run.append(row)
        size += len(text or "")
    if run:
        yield run


def align_texts(df: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per row of ``df``: its key, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``groups_sha256`` and ``links``
    (little-endian unsigned 32-bit numbers of linked pairs, one a cut, for the functions below); on
    request ``groups`` (their text) and ``cuts`` (byte offsets in a space and the text where groups
    end).

    Null and empty texts, and those whose tokens don't join to a space and the text, have no tokens:
    zeros and an empty hash. Repeated rows and null keys give a row each; other columns don't matter.
    Texts are encoded in chunks cut at single spaces, where both tokenizers start anew, and recurring
    chunks once; a text without such spaces is encoded whole. Rows stay where they are: no shuffle.
    """
    more = ", groups string, cuts array<long>" if keep_groups else ""
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a_path, b_path)
        for batch in pieces(batches, 500):
            texts = batch.column(1).to_pylist()
            n = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups")}
            hashes, links, groups, cuts = [""] * len(texts), [b""] * len(texts), [""] * len(texts), [[]] * len(texts)
            for rows in _runs(texts):
                encoded = {row: ids for row, ids in zip(rows, own.encode([texts[row] for row in rows])) if ids}
                if not encoded:
                    continue
                aligned = own.align(list(encoded.values()))
                linked, before = own.links(aligned), 0
                for row, to, said in zip(encoded, aligned.text_cuts.tolist(), own.group_texts(aligned)):
                    n["n_a"][row], n["n_b"][row], n["n_groups"][row] = *map(len, encoded[row]), to - before
                    hashes[row], links[row] = hashlib.sha256(said.encode()).hexdigest(), linked[before:to].astype("<u4").tobytes()
                    if keep_groups:
                        groups[row], cuts[row] = said, (aligned.cuts[before:to] - (aligned.cuts[before - 1] if before else 0)).tolist()
                    before = to
            columns = [batch.column(0), *map(pa.array, n.values()), pa.array(hashes, pa.string()), pa.array(links, pa.binary())]
            names = [key, *n, "groups_sha256", "links"]
            if keep_groups:
                columns, names = [*columns, pa.array(groups, pa.string()), pa.array(cuts, pa.list_(pa.int64()))], [*names, "groups", "cuts"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _pair_rows(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): each task counts into one array and sends what it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for links in batch.column(0):
                places, n = np.unique(np.frombuffer(links.as_buffer() or b"", "<u4"), return_counts=True)
                total[places] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id``, ``b_id``, ``n``: how many links of all texts hold the two ids linked."""
    pairs = _aligner(a_path, b_path).pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a_path, b_path).pairs.astype(np.int64)
        for batch in batches:
            pair = own[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), batch.column(1)], ["a_id", "b_id", "n"])

    return _pair_rows(aligned, len(pairs)).mapInArrow(run, "a_id long, b_id long, n long")


def with_support(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``n_links``, ``n_best`` and ``count_sum`` beside the columns of ``align_texts``, which must come
    from a written table as it's read twice. The counts that tasks are told have one number a pair of
    the vocabularies that can be linked at all, whatever the corpus."""
    spark = aligned.sparkSession
    own = _aligner(a_path, b_path)
    counts = np.zeros(len(own.pairs), np.int64)
    met = _pair_rows(aligned, len(counts)).toArrow()  # len(own.pairs) rows at most
    counts[met["pair"].to_numpy()] = met["n"].to_numpy()
    best = np.zeros(len(own.b_bytes), np.int64)
    np.maximum.at(best, own.best_of, counts)
    told = spark.sparkContext.broadcast((counts, counts == best[own.best_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_best = told.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, links in enumerate(batch.column(batch.schema.get_field_index("links"))):
                places = np.frombuffer(links.as_buffer() or b"", "<u4")
                out[:, row] = len(places), is_best[places].sum(), counts[places].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {t}" for c, t in aligned.dtypes)
    return aligned.mapInArrow(run, schema + ", n_links long, n_best long, count_sum long")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = written(align_texts(table(spark, sf_dir, "documents"), *files), "aligned")
    return with_support(aligned, *files).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
