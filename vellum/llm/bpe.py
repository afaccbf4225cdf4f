"""Byte-level BPE encoding and decoding (operator 4).

A pattern cuts a text into pieces.  A piece's bytes are read as Latin-1
characters, and an Aho-Corasick automaton over the vocabulary lists in one pass
the tokens that start at each position.  The encoder takes the longest token,
checks that it may follow the one before, and steps back to shorter tokens
where nothing fits.  Two tokens may stand side by side if the merges of their
joined bytes end in just these two; that answer is memoised by pair.  Every
prefix of a piece has one encoding, so a position that failed once is never
entered again: time is linear in the piece, however long it is, and the ids
equal those of the merge loop.

Edge cases: a null text counts as empty and gives no ids; an empty table gives
an empty table; ids that the vocabulary lacks raise an error in decoding.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import map_batches, worker_cache

SHIFT = 21          # pair keys: first << SHIFT | second
PIECES_KEPT = 150_000  # memoised pieces of a worker: the first ones, so the frequent ones
PIECE_BYTES = 64    # longer pieces are encoded but not memoised
PAIRS_KEPT = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    tokens = [found[i] for i in range(len(found))]
    if {len(t) for t in tokens[:256]} != {1} or len(set(tokens[:256])) != 256:
        raise ValueError("the first 256 ranks must be the single bytes")
    return tokens


class Merges:
    """Which tokens may stand side by side."""

    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]] | None = None):
        self.tokens = tokens
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self.joined: dict[int, int] = {}
        self.seen: dict[int, bool] = {}
        if halves is None:
            self._learn()
        else:
            for t, (a, b) in enumerate(halves):
                if a >= 0:
                    self._set(t, a, b)

    def _set(self, token: int, a: int, b: int) -> None:
        self.left[token], self.right[token] = a, b
        self.joined[a << SHIFT | b] = token

    def _learn(self) -> None:
        """Find, in rank order, the two tokens whose merge makes each token."""
        ranks = {t: i for i, t in enumerate(self.tokens)}
        for token in range(256, len(self.tokens)):
            whole = self.tokens[token]
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut], token), ranks.get(whole[cut:], token)
                if a < token and b < token and self.compatible(a, b):
                    self._set(token, a, b)
                    break
            else:
                raise ValueError(f"rank {token} is not a merge of earlier ranks")
        self.seen.clear()  # answers given while merges were still unknown

    def halves(self) -> list[tuple[int, int]]:
        return [(a, b) if a != t else (-1, -1)
                for t, (a, b) in enumerate(zip(self.left, self.right, strict=True))]

    def compatible(self, first: int, second: int) -> bool:
        """True if merging the joined bytes ends in ``first``, ``second``.

        Undo the merges on both sides of the border, latest first; at each step
        the two tokens that then touch must not merge before the undone merge.
        Of equal merges the left one goes first.
        """
        key = first << SHIFT | second
        known = self.seen.get(key)
        if known is not None:
            return known
        joined, left, right = self.joined, self.left, self.right
        a, b, before, answer = first, second, 1 << 60, True
        while True:
            if joined.get(a << SHIFT | b, 1 << 60) < before:
                answer = False
                break
            if max(a, b) < 256:
                break
            if a > b:
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]
        if len(self.seen) >= PAIRS_KEPT:
            self.seen.clear()
        self.seen[key] = answer
        return answer


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Tokens and their halves, read and derived once on the driver."""
    tokens = read_ranks(path)
    return tokens, Merges(tokens).halves()


class Encoder:
    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]], pattern: str):
        import ahocorasick
        import regex

        self.merges = Merges(tokens, halves)
        self.size = [len(t) for t in tokens]
        self.whole = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def forget(self) -> None:
        """Leave little in an idle worker."""
        self.merges.seen.clear()

    def piece(self, text: str) -> list[int]:
        """Ids of the merges of a piece, given as Latin-1 characters."""
        n, size, fits = len(text), self.size, self.merges.compatible
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(text):
            starting[end + 1 - size[token]].append(token)  # shorter ones come first
        failed = bytearray(n + 1)
        ids: list[int] = []
        tried: list[int] = []  # for each id, its place in its position's list
        pos, last, at = 0, -1, len(starting[0]) - 1
        while pos < n:
            here = starting[pos]
            while at >= 0:
                token = here[at]
                if not failed[pos + size[token]] and (last < 0 or fits(last, token)):
                    break
                at -= 1
            if at >= 0:
                ids.append(token)
                tried.append(at)
                last, pos = token, pos + size[token]
                at = len(starting[pos]) - 1 if pos < n else -1
            else:
                failed[pos] = 1
                token, at = ids.pop(), tried.pop() - 1
                pos -= size[token]
                last = ids[-1] if ids else -1
        return ids

    def lookup(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        text = raw.decode("latin-1")
        token = self.whole.get(text)
        ids = [token] if token is not None else self.piece(text)
        out = np.array(ids, "<u4").tobytes()
        if len(raw) <= PIECE_BYTES and len(self.kept) < PIECES_KEPT:
            self.kept[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        kept, lookup = self.kept.get, self.lookup
        return b"".join([kept(p) or lookup(p) for p in self.pieces(text)])


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: ids of ``text`` as little-endian unsigned 32-bit integers.

    ``path`` names a rank file that the driver reads; workers get the fixed-size
    vocabulary by broadcast.  ``keep`` lists the columns to carry (all by
    default; one named ``out`` is replaced).
    """
    # a vocabulary is a fixed table of some megabytes, whatever the input's size
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        enc = worker_cache(f"bpe {path} {pattern}", lambda: Encoder(*shared.value, pattern))

        def run(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([enc.encode(t) if t else b"" for t in texts.to_pylist()], pa.binary())]

        run.close = enc.forget
        return run

    return map_batches(df, [text], T.StructType([T.StructField(out, T.BinaryType())]),
                       df.columns if keep is None else keep, make)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded",
               keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the bytes that ``ids`` (as `bpe_encode` writes them) stand for."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        token = shared.value.__getitem__
        return lambda col: [pa.array(
            [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b""
             for x in col.to_pylist()], pa.binary())]

    return map_batches(df, [ids], T.StructType([T.StructField(out, T.BinaryType())]),
                       df.columns if keep is None else keep, make)
