"""SentencePiece (merge type) encoding and decoding by a prefix table.

A text splits into chunks that no piece crosses: no piece has a space mark after another character,
and none has a character the vocabulary lacks. Inside a chunk every prefix has exactly one last
piece: of the pieces ending there (found by a walk over an automaton of all pieces), the longest one
that can follow the last piece of the shorter prefix, where a pair can stand side by side if
merging its two texts would end in that pair again. The table of last pieces is read backwards for
the ids. Chunks are kept in a bounded memo, since words recur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

MARK = "▁"
#: Entries that a worker remembers at most: chunks (about 20 MB) and pairs of pieces (about 25 MB).
MEMO, PAIRS = 100_000, 300_000
_models: dict[str, PieceModel] = {}


class PieceModel:
    """A merge-type piece file with byte fallback: identity normalizer, dummy prefix, all spaces kept."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.byte = {}
        self.pieces: list[str | int] = []  # text; a byte's value; or "" for a control piece
        self.id: dict[str, int] = {}
        scores = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.pieces.append(int(piece[3:5], 16))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.pieces.append("")
            else:
                self.pieces.append(piece)
                self.id[piece], scores[piece] = i, sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans two words; chunks can't be cut at spaces")
        self.score = scores
        self.alphabet = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merged(p) == [p]:  # no text gives the other pieces
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.chunk = re.compile(f"{MARK}*[^{MARK}\\n]+|\\n|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """Merge by rule: of adjacent pieces whose joint text is a piece, the best-scored first, the
        leftmost of equals. Only for the texts of one or two pieces, to fill the tables below."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces can stand side by side; remembered in ``fits``."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        a, b = self.pieces[left], self.pieces[right]
        known = self.fits[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def run(self, text: str) -> list[int]:
        """Ids of a text over the alphabet. last[k]: id and length of the last piece of the prefix of
        k characters; the automaton gives the pieces ending at a place from the longest on."""
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        fits = self.fits.get
        for end, found in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - found[1]
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fit = fits(before[0] << 20 | found[0])
                    if not (self.compatible(before[0], found[0]) if fit is None else fit):
                        continue
                last[end + 1] = found
        ids, at = [], len(text)
        while at:
            piece, size = last[at]
            ids.append(piece)
            at -= size
        return ids[::-1]

    def chunk_ids(self, chunk: str) -> bytes:
        known = self.memo.get(chunk)
        if known is None:
            if self.alphabet.issuperset(chunk):
                ids = self.run(chunk)
            else:
                ids, part = [], ""
                for c in chunk:
                    if c in self.alphabet:
                        part += c
                    else:
                        ids += [*self.run(part), *(self.byte[b] for b in c.encode())]
                        part = ""
                ids += self.run(part)
            known = np.array(ids, "<u4").tobytes()
            if len(chunk) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, begin and end ids included."""
        edge = np.array([self.begin, self.end], "<u4").tobytes()
        if not text:
            return edge
        memo, miss = self.memo.get, self.chunk_ids
        parts = [memo(c) or miss(c) for c in self.chunk.findall(MARK + text.replace(" ", MARK))]
        return edge[:4] + b"".join(parts) + edge[4:]

    def decode(self, ids: bytes) -> str:
        """Text of ids: the space before the first piece goes, bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "raw"):
            self.raw = [bytes([p]) if isinstance(p, int) else p.replace(MARK, " ").encode() for p in self.pieces]
        raw = self.raw
        out = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        first = next((self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist() if self.pieces[i] != ""), "")
        if isinstance(first, str) and first.startswith(MARK):
            out = out[1:]
        return out.decode("utf-8", "replace")


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(df: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """Per row of ``df``: its key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and on request
    the ids (binary, little-endian unsigned 32-bit) and the decoded text. Null texts encode as empty
    ones, which have the begin and end ids only. Repeated rows and null keys give a row each; other
    columns don't matter. Rows stay where they are: no shuffle. A worker keeps the model (20 MB) for
    its next partition, but not the chunks it met.
    """
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids + ", decoded string" * keep_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in pieces(batches):
            n, a, b, ids, decoded = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                x = own.encode(t or "")
                y = own.decode(x)
                n.append(len(x) // 4)
                a.append(hashlib.sha256(x).hexdigest())
                b.append(hashlib.sha256(y.encode()).hexdigest())
                if keep_ids:
                    ids.append(x)
                if keep_decoded:
                    decoded.append(y)
            more = [pa.array(ids, pa.binary())] * keep_ids + [pa.array(decoded, pa.string())] * keep_decoded
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *more], [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_decoded])
        own.memo.clear()

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
