"""Byte-level BPE encoding and decoding.

Texts of an Arrow batch are laid end to end as one code-point array. A table
gives each code point its class; the pre-tokeniser is a small automaton over
classes whose step is a function state -> state. Functions compose
associatively, so all blocks of the array are scanned at once: first every
block's composed function, then a prefix scan over the blocks, then the states
inside the blocks. Token boundaries follow from neighbouring states. The byte
slices between boundaries go through cached pair merging by rank.

Results: ids (little-endian unsigned 32 bit, packed), the byte offset of each
token's end (packed likewise) and the text decoded from the ids. Null or empty
text: no tokens. Rows are independent, so null keys, repeated rows, empty tables
and extra columns need no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

# classes of code points
(LETTER, STMD, R_V, E, L, NUMBER, SPACE, WHITE, APOS, OTHER, EDGE) = range(11)
# states: what the token that holds the last code point is
(NONE, IN_L, IN_N, IN_O, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_RV, QUOTE_L, SHORT) = range(10)
N_STATES = 10
BLOCK = 128
CACHE_SLICES = 200_000


def _step_table() -> np.ndarray:
    """next state by (class, state), flat."""
    step = np.zeros((11, N_STATES), np.uint8)
    for s in range(N_STATES):
        for c in (LETTER, STMD, R_V, E, L):
            step[c, s] = IN_L
        step[NUMBER, s], step[SPACE, s], step[WHITE, s], step[OTHER, s] = IN_N, AFTER_SPACE, AFTER_WHITE, IN_O
        # an apostrophe opens a token unless a space or an "other" run takes it in
        step[APOS, s] = IN_O if s in (IN_O, AFTER_SPACE, QUOTE) else QUOTE
        step[EDGE, s] = NONE
    step[STMD, QUOTE], step[R_V, QUOTE], step[L, QUOTE] = SHORT, QUOTE_RV, QUOTE_L
    step[E, QUOTE_RV], step[L, QUOTE_L] = SHORT, SHORT
    return step.ravel()


STEP = _step_table()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letters and numbers by general category, from the
    newest Unicode tables at hand (those of the ``regex`` library)."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, category in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(category, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    # White_Space: str.isspace() without the four separators U+001C..U+001F
    white = [i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    table[white] = WHITE
    for chars, kind in (("stmd", STMD), ("rv", R_V), ("e", E), ("l", L), (" ", SPACE), ("'", APOS)):
        table[[ord(c) for c in chars]] = kind
    return table


def states_of(classes: np.ndarray) -> np.ndarray:
    """State after each position, by an associative scan of step functions."""
    n = len(classes)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, EDGE, np.intp)
    padded[:n] = classes
    by_step = np.ascontiguousarray((padded * N_STATES).reshape(blocks, BLOCK).T)
    # 1: composed function of every block
    f = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for row in by_step:
        f = STEP[row[:, None] + f]
    # 2: inclusive prefix scan of the functions over the blocks (doubling)
    shift = 1
    while shift < blocks:
        f[shift:] = np.take_along_axis(f[shift:], f[:-shift].astype(np.intp), axis=1)
        shift *= 2
    entry = np.zeros(blocks, np.uint8)
    entry[1:] = f[:-1, NONE]
    # 3: states inside the blocks
    out = np.empty((BLOCK, blocks), np.uint8)
    for k, row in enumerate(by_step):
        entry = out[k] = STEP[row + entry]
    return out.T.ravel()[:n]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a token starts. ``classes`` has an EDGE between texts and at both ends."""
    state = states_of(classes)
    start = np.zeros(len(classes), bool)
    before, now, after = state[:-2], state[1:-1], state[2:]
    cls, follow = classes[1:-1], classes[2:]
    white = (cls == SPACE) | (cls == WHITE)
    white_before = (before == AFTER_SPACE) | (before == AFTER_WHITE)
    solid_after = (follow != SPACE) & (follow != WHITE) & (follow != EDGE)
    letter = cls <= L
    # a white run gives its last character away when something solid follows
    first = np.where(white, ~white_before | solid_after, False)
    # solid characters open a token when the run they belong to changes; a space joins them
    first |= letter & (before != IN_L) & (before != AFTER_SPACE) & (now == IN_L) \
        & ~((before == QUOTE_RV) | (before == QUOTE_L))
    first |= (cls == NUMBER) & (before != IN_N) & (before != AFTER_SPACE)
    first |= ((cls == OTHER) | (cls == APOS)) & (before != IN_O) & (before != AFTER_SPACE) & (before != QUOTE)
    # 'r 'v 'l that turn out not to be a short form: the letter opens a token after all
    open_short = (now == QUOTE_RV) | (now == QUOTE_L)
    first |= open_short & (after != SHORT)
    first &= cls != EDGE
    start[1:-1] = first
    return start


class Ranks:
    """Pair merging by rank, with a bounded cache of slices."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for piece, i in self.rank.items():
            self.token[i] = piece
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.cache: dict[bytes, bytes] = {}  # slice -> its ids, packed

    def learn(self, pieces: list[bytes]) -> None:
        """Put every piece into the cache; those not there are merged together."""
        missing = set(pieces) - self.cache.keys()
        if not missing:
            return
        if len(self.cache) + len(missing) > CACHE_SLICES:
            self.cache.clear()
            missing = set(pieces)
        rank, by_length = self.rank, {}
        for piece in missing:
            if (whole := rank.get(piece)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(piece) > 48:
                self.cache[piece] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append(piece)
        for n, same in by_length.items():
            parts = self._merge_together(np.frombuffer(b"".join(same), np.uint8).reshape(len(same), n))
            self.cache.update(zip(same, parts))

    def _pair_table(self) -> None:
        """Open-addressing table (left id, right id) -> id of the joined piece."""
        rank = self.rank
        pairs = [(a * self.size + b, i) for piece, i in rank.items() for k in range(1, len(piece))
                 if (a := rank.get(piece[:k])) is not None and (b := rank.get(piece[k:])) is not None]
        keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        self.bits = max(12, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.size, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            slot, keys, values = (slot[~placed] + 1) & ((1 << self.bits) - 1), keys[~placed], values[~placed]
        self.byte_id = np.array([rank[bytes([i])] for i in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``size`` where the pair doesn't join."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        out, found = self.values[slot], self.keys[slot]
        rest = np.flatnonzero((found != keys) & (found != -1))
        out = np.where(found == keys, out, self.size).astype(np.int32)
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def _merge_together(self, raw: np.ndarray) -> list[bytes]:
        """merge() of many slices of one length; each step joins one pair in every slice."""
        if not hasattr(self, "keys"):
            self._pair_table()
        ids = self.byte_id[raw]
        m, n = ids.shape
        none = self.size
        cost = self._joined(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, n - 1)
        out = [b""] * m
        origin = np.arange(m)
        while True:
            best = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(ids), np.int64)
            low = cost[np.arange(len(ids)), best] if cost.shape[1] else np.full(len(ids), none)
            done = low == none
            if done.any():
                packed, size = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, k in enumerate(origin[done].tolist()):
                    out[k] = packed[i * size:(i + 1) * size]
                keep = ~done
                ids, cost, best, low, origin = ids[keep], cost[keep], best[keep], low[keep], origin[keep]
            if not len(ids):
                return out
            rows, width = np.arange(len(ids)), ids.shape[1]
            ids[rows, best] = low
            ids = ids[np.arange(width)[None, :] != (best + 1)[:, None]].reshape(-1, width - 1)
            cost = cost[np.arange(width - 1)[None, :] != best[:, None]].reshape(-1, width - 2)
            if width > 2:
                right = np.flatnonzero(best < width - 2)
                b = best[right]
                cost[right, b] = self._joined(ids[right, b], ids[right, b + 1])
                left = np.flatnonzero(best > 0)
                b = best[left]
                cost[left, b - 1] = self._joined(ids[left, b - 1], ids[left, b])

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank (leftmost first) until none is left."""
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        cuts = list(range(len(piece) + 1))
        none = self.size
        cost = [rank.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while cost:
            best = min(cost)
            if best == none:
                break
            i = cost.index(best)
            del cuts[i + 1], cost[i]
            if i < len(cost):
                cost[i] = rank.get(piece[cuts[i]:cuts[i + 2]], none)
            if i:
                cost[i - 1] = rank.get(piece[cuts[i - 1]:cuts[i + 1]], none)
        return tuple(rank[piece[a:b]] for a, b in zip(cuts, cuts[1:]))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked cuts: n log n, for very long slices."""
        import heapq

        rank, n = self.rank, len(piece)
        right, left = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray([1]) * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = right[i]
            if 0 <= i and j < n and (r := rank.get(piece[i:right[j]])) is not None:
                heapq.heappush(heap, (r, i, j, right[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or right[i] != j or not alive[j] or right[j] != k:
                continue
            alive[j] = 0
            right[i] = k
            if k < n:
                left[k] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i:right[i]]])
            i = right[i]
        return tuple(out)


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    """One rank table for each Python worker and file."""
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


def encode_many(texts: list[str], ranks: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, byte offset of each token's end) of every text."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(np.r_[1, sizes + 1])  # of each text, and after the last
    classes = class_table()[points]
    classes[begins - 1] = EDGE
    starts = np.flatnonzero(boundaries(classes))
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at_byte = np.cumsum(np.r_[0, width])[starts]
    edges = np.searchsorted(starts, begins)
    base = np.cumsum(np.r_[0, width])[begins]
    pieces, until = [], []
    for k, text in enumerate(texts):
        raw = text.encode()
        cuts = (at_byte[edges[k]:edges[k + 1]] - base[k]).tolist()
        cuts.append(len(raw))
        pieces += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        until.append(len(pieces))
    ranks.learn(pieces)
    get, at = ranks.cache.__getitem__, 0
    for end in until:
        ids = np.frombuffer(b"".join(map(get, pieces[at:end])), "<u4")
        yield ids, np.cumsum(ranks.length[ids])
        at = end


def decode(ids: np.ndarray, ranks: Ranks) -> bytes:
    token = ranks.token
    return b"".join([token[i] for i in ids.tolist()])


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           digests: bool = False) -> DataFrame:
    """One row per document: the key, ``n_tokens``, and either ``ids``, ``ends`` (packed
    little-endian unsigned 32 bit: token ids and byte offsets of token ends) and ``decoded``
    (bytes, from the ids), or with ``digests`` their SHA-256 in hex.
    ``vocabulary``: path of a rank file, readable on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()
    small = "ids_sha256 string, decoded_sha256 string"
    schema = f"`{id_col}` {kind}, n_tokens bigint, " + (small if digests else "ids binary, ends binary, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(vocabulary)
        sha = hashlib.sha256
        for batch in sliced(batches, 1):
            n, a, b, c = [], [], [], []
            for ids, ends in encode_many([t or "" for t in batch.column(1).to_pylist()], ranks):
                raw = decode(ids, ranks)
                n.append(len(ids))
                if digests:
                    a.append(sha(ids.tobytes()).hexdigest())
                    c.append(sha(raw).hexdigest())
                else:
                    a.append(ids.tobytes())
                    b.append(ends.astype("<u4").tobytes())
                    c.append(raw)
            columns = [batch.column(0), pa.array(n, pa.int64())]
            if digests:
                columns += [pa.array(a, pa.string()), pa.array(c, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns += [pa.array(x, pa.binary()) for x in (a, b, c)]
                names = [id_col, "n_tokens", "ids", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests as the contract names them."""
    return encode(table(spark, sf_dir, "documents"), default_vocabulary(), digests=True)
