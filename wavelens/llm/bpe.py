"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs no regular expression over the text. Each codepoint is looked up in a class array; together with its
neighbour it becomes a symbol, each symbol is a transition function over eight states, and the composition of these
functions, which is associative, is scanned in blocks over a whole batch of documents at once. The state before a symbol
tells whether a piece starts there. The byte slices between starts go through pair merging with a cache; their offsets are
kept, so any token range can be mapped back to bytes of the document.

Null texts count as empty. Any text is encoded whole; decoding returns the very bytes that were encoded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

RESET, LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE, WS_LAST, WS_INNER = range(9)
NONE, IN_L, IN_N, IN_O, IN_W, PENDING, NEED1, NEED2 = range(8)
_STARTS = 8  # flag in a transition: a piece starts at this symbol
_BLOCK = 64
_NEVER = 1 << 40


def _transitions() -> np.ndarray:
    """[symbol, state] -> next state, plus the flag if a piece starts at the symbol."""
    t = np.zeros((9, 8), np.uint8)
    t[RESET] = NONE | _STARTS
    t[LETTER] = IN_L | _STARTS
    t[LETTER, [IN_L, PENDING]] = IN_L
    t[LETTER, NEED2] = NEED1
    t[LETTER, NEED1] = NONE
    t[NUMBER] = IN_N | _STARTS
    t[NUMBER, [IN_N, PENDING]] = IN_N
    for symbol, alone in ((OTHER, IN_O), (APOS1, NEED1), (APOS2, NEED2)):
        t[symbol] = alone | _STARTS
        t[symbol, [IN_O, PENDING]] = IN_O
    t[SPACE] = PENDING | _STARTS
    t[WS_LAST] = NONE | _STARTS
    t[WS_INNER] = IN_W | _STARTS
    t[WS_INNER, IN_W] = IN_W
    return t


TRANSITIONS = _transitions()


@lru_cache(1)
def class_array() -> np.ndarray:
    """Class of every codepoint: LETTER, NUMBER, WS_INNER (white space) or OTHER.

    The classes are asked once from the tokenizer library's own engine, which knows newer letters than Python's tables do.
    """
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WS_INNER, r"\s")):
        probe = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = probe.decode(probe.encode_ordinary(everything))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = symbol
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of a run of documents; ``ends`` are the positions of the separators between and after them."""
    cls = class_array()[points]
    cls[ends] = RESET
    white = cls == WS_INNER
    after = np.ones(len(cls), bool)  # white space or the document's end follows
    after[:-1] = white[1:] | (cls[1:] == RESET)
    out = cls.copy()
    out[white & ~after] = WS_LAST
    out[white & ~after & (points == 32)] = SPACE
    at = np.flatnonzero((points == 39) & (cls == OTHER))
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS1
        pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[at[pairs]] = APOS2
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol: a blocked scan over composed transition functions."""
    n = len(sym)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, RESET, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    step = (TRANSITIONS & 7).ravel()
    # each block's function, then all prefixes of blocks by doubling
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for row in grid:
        f = step[(row.astype(np.uint16) * 8)[:, None] + f]
    reach, f = 1, f.copy()
    while reach < blocks:
        f[reach:] = np.take_along_axis(f[reach:], f[:-reach], 1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = f[:-1, NONE]
    flat, starts = TRANSITIONS.ravel(), np.empty(grid.shape, bool)
    for j, row in enumerate(grid):
        got = flat[row.astype(np.uint16) * 8 + state]
        starts[j] = got >= _STARTS
        state = got & 7
    return starts.T.ravel()[:n]


class ByteBPE:
    """Encoder and decoder for one file of ranks (base64 token, rank a line)."""

    CACHE, LONG = 1 << 18, 96

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)])
        keys = sorted((x * len(self.tokens) + y, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (x := self.ranks.get(t[:i])) is not None and (y := self.ranks.get(t[i:])) is not None)
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*keys))

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece: the adjacent pair of the lowest rank merges first, the leftmost of equals.

        All pieces of similar length advance together, one merge a row and round, as rows of an id matrix.
        """
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        wide: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > self.LONG:
                out[i] = self._merge_long(piece)
            else:
                wide.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in wide.items():
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            size = np.array([len(pieces[i]) for i in rows])
            ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1)
            at, pair = np.array(rows), self._pair(ids[:, :-1], ids[:, 1:])
            while len(at):
                best = pair.argmin(1)
                live = pair[np.arange(len(at)), best] < _NEVER
                for i, row in zip(at[~live].tolist(), ids[~live].tolist()):
                    out[i] = tuple(row[: row.index(-1)] if row[-1] < 0 else row)
                at, ids, pair, best = at[live], ids[live], pair[live], best[live]
                if not len(at):
                    break
                line, w = np.arange(len(at)), ids.shape[1]
                ids[line, best] = pair[line, best]
                keep = np.arange(w) != (best + 1)[:, None]
                ids = np.concatenate([ids[keep].reshape(len(at), w - 1), np.full((len(at), 1), -1, ids.dtype)], 1)[:, : max(w - 1, 2)]
                keep = np.arange(w - 1) != best[:, None]
                pair = np.concatenate([pair[keep].reshape(len(at), w - 2), np.full((len(at), 1), _NEVER, pair.dtype)], 1)[:, : ids.shape[1] - 1]
                pair[line, np.minimum(best, pair.shape[1] - 1)] = np.where(best < pair.shape[1], self._pair(ids[line, best], ids[line, np.minimum(best + 1, ids.shape[1] - 1)]), pair[line, -1])
                left = np.flatnonzero(best > 0)
                pair[left, best[left] - 1] = self._pair(ids[left, best[left] - 1], ids[left, best[left]])
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that ids a and b form together, or _NEVER."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * len(self.tokens) + b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for long pieces."""
        ranks, n = self.ranks, len(piece)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text its ids and the byte offsets of its pieces (one more than pieces)."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        joined = "\0".join(strings) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        starts = np.flatnonzero(piece_starts(symbols(points, ends)))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        buf = joined.encode("utf-8")
        cut = at[starts].tolist()
        pieces = [buf[a:b] for a, b in zip(cut, [*cut[1:], len(buf)])]
        distinct = set(pieces)
        cache, first = self.cache, 0
        if len(cache) + len(distinct) > self.CACHE:
            cache.clear()
        new = [p for p in distinct if p not in cache]
        cache.update(zip(new, self.merge(new)))
        last = np.searchsorted(starts, ends)  # each separator starts a piece of its own
        for k in last.tolist():
            offsets = at[starts[first : k + 1]]
            ids = map(cache.__getitem__, pieces[first:k])
            yield list(chain.from_iterable(ids)), offsets - offsets[0]
            first = k + 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def encoder(path: str) -> ByteBPE:
    """One encoder a Python worker and file; its many small tuples are no work for the cycle collector."""
    gc.set_threshold(200_000, 50, 100)
    return ByteBPE(path)


def encode_documents(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` and ``piece_offsets`` (byte offsets of the pre-tokens, the text's length last) to every row.

    ``path`` is the rank file, readable on every executor. Columns of these names are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in ("token_ids", "piece_offsets")]
    schema = T.StructType([*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_offsets", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in keep]

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                got = list(bpe.encode(texts))
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                ids, offs = ([g[i] for g in got] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(offs, pa.list_(pa.int32()))], [*names, "token_ids", "piece_offsets"])

    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of the id column as a binary column ``out``; a null list decodes to no bytes."""
    keep = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([bpe.decode(v or []) for v in values], pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids, and returns (key, n_tokens, ids_sha256, decoded_sha256); ids never leave the worker."""
    src = df.select(key, text)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                n, a, b = [], [], []
                for ids, _ in bpe.encode(texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema.names)

    return src.mapInArrow(run, schema)
