"""Operator 8: byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over
the vocabulary finds, for every position, the longest token that starts there.
A piece is then encoded by taking longest matches and backtracking to the
next shorter one whenever the last two tokens could not stand side by side in
an output of the merge procedure. Whether two tokens can is decided once per
pair, by merging their joined bytes, and memoised. A piece that is itself a
vocabulary entry is that entry.

Defined results: null or empty text gives no ids (and decodes to no bytes);
unpaired surrogates cannot occur in Spark strings; a text of any length is
encoded whole. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinfold.llm._shared import in_parts, texts

#: The ranges that the quick splitter covers: every character below U+0180 that is a letter, besides ª º and the like, is found by its class.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼-¾]+|\s+(?!\S)|\s+")
_NOT_QUICK = re.compile(r"[^\x00-\x1b\x20-ſ]")


class Splitter:
    """Matches of a tokenizer's pattern. Texts below U+0180 take Python's own ``re`` with the classes written out."""

    def __init__(self, pattern: str):
        self.slow = regex.compile(pattern).findall
        self.quick = _QUICK.findall if pattern == _default_pattern() else self.slow

    def __call__(self, text: str) -> list[str]:
        return (self.slow if _NOT_QUICK.search(text) else self.quick)(text)


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceEncoder:
    """Encodes one piece of bytes by longest matches with backtracking."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        reachable = {}
        for token, rank in ranks.items():
            if len(token) == 1 or self._merge(token) == [rank]:
                reachable[token] = rank
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for token, rank in reachable.items():
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in reachable:
                    self.shorter[rank] = reachable[token[:end]]
                    break
        self.length = {v: len(k) for k, v in ranks.items()}

    def _merge(self, piece: bytes) -> list[int]:
        """The merge procedure as defined: join the adjacent pair of lowest rank until none is known."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def longest_at(self, piece: bytes) -> list[int]:
        """For each position, the longest token starting there."""
        best = [-1] * len(piece)
        length = self.length
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            best[end + 1 - length[rank]] = rank  # ends ascend, so the last to come is the longest
        return best

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        best, n = self.longest_at(piece), len(piece)
        dead = bytearray(n + 1)  # positions from which no valid encoding goes on
        out: list[int] = []
        at, token = 0, best[0] if n else None
        while at < n:
            while token is not None:
                end = at + self.length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:
                dead[at] = 1
                token = out.pop()  # tried again: its end is dead now, so a shorter one is taken
                at -= self.length[token]
            else:
                out.append(token)
                at = end
                token = best[at] if at < n else None
        return out


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; cleared when it holds ``bound`` pieces.

    Pieces of more than ``LONGEST`` characters are not kept, which bounds the bytes held.
    """

    LONGEST = 64

    def __init__(self, encoder: PieceEncoder, bound: int = 1_000_000):
        self.encoder, self.bound = encoder, bound

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        ids = b"".join(i.to_bytes(4, "little") for i in self.encoder.encode(piece.encode()))
        if len(piece) <= self.LONGEST:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of whole texts for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.split = Splitter(pattern)
        self.pieces = Pieces(PieceEncoder(ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids, four bytes each."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def bpe_encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row; null text gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in in_parts(batches, 1):
            ids = [memoryview(code.encode(t)).cast("I").tolist() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, id_col: str, ids_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """``id_col`` and ``bytes`` (binary) for every row of ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(vocabulary, pattern).bytes_of
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def bpe_digest(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of what the ids decode to. One pass, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in in_parts(batches, 1):
            counts, digests, decoded = [], [], []
            for text in texts(batch.column(1)):
                ids = code.encode(text)
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
