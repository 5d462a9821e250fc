"""Secret scans by a linear-chain conditional random field.

Words are tagged as secret begin, inside or outside. A word's features are its
shape (length, character kinds, mixture, quotes, known key words), the shapes of
both neighbours and features of the file (share of words with ``=`` or ``:``, key
words anywhere). Weights are trained here by gradient ascent on the likelihood,
on windows around spans that fixed patterns find and windows without any, from at
most ``MAX_FIT`` texts of either sort: all rows are searched for spans, the texts are
the least hashes of either sort, and their windows, anywhere in the text, are cut in
Spark tasks. Decoding is Viterbi. A bound shows which
words can't be anything but outside on a best path; Viterbi runs over the rest,
and so finds the same path as over the whole text.

Spans of the fixed patterns (kinds assign, access, hex) always stay; the model
adds spans of kind crf that touch none of them. Null or empty text: no spans.
Without any pattern span to learn from the model adds none. Rows are judged one
by one, so null keys, repeated rows and extra columns need no special case; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASES, Rolling, freed, landed, sliced, table
from .runs import BYTE_UNITS
from .substring_dedup import word_bounds

#: Fixed patterns of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 or more in all
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words that often stand before a secret.
KEY_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "bearer", "credential", "credentials"]

MAX_FIT = 300  # texts with pattern spans, and as many without, that the model is fitted on
SIDE = 12  # words on either side of a training window
PER_TEXT = 8
MAX_WINDOWS = 400  # of either sort
STEPS, RATE, DECAY = 120, 0.1, 1e-3
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


# --- features -------------------------------------------------------------------

def _kinds() -> np.ndarray:
    """Byte kinds as bits: digit, lower, upper, hex letter, assignment sign, quote, other sign, not ASCII."""
    kind = np.zeros(256, np.uint8)
    for i in range(256):
        c = chr(i)
        if i > 127:
            kind[i] = 128
        elif c.isdigit():
            kind[i] = 1
        elif c.islower():
            kind[i] = 2 | (8 if c in "abcdef" else 0)
        elif c.isupper():
            kind[i] = 4
        elif c in "=:":
            kind[i] = 16
        elif c in "\"'`":
            kind[i] = 32
        else:
            kind[i] = 64
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGES = np.array([3, 6, 12, 20, 32])


def _word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_UNITS[_LOWER[raw]], BASES[0]).spans(start, end)


def _key_hashes() -> np.ndarray:
    out = []
    for w in KEY_WORDS:
        raw = np.frombuffer(w.encode(), np.uint8)
        out.append(_word_hash(raw, np.array([0]), np.array([len(raw)]))[0])
    return np.sort(np.array(out, np.uint64))


_KEYS = _key_hashes()
N_SHAPE = 24
N_FILE = 4
N_FEATURES = 3 * N_SHAPE + N_FILE


def trimmed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without quotes, assignment and closing signs around (at most three of a side)."""
    cut = _KIND & (16 | 32) > 0
    cut[[ord(c) for c in ",;()[]{}<>#."]] = True
    a, b = start.copy(), end.copy()
    for _ in range(3):
        a += (a < b) & cut[raw[np.minimum(a, len(raw) - 1)]]
        b -= (a < b) & cut[raw[np.maximum(b - 1, 0)]]
    return a, b


def shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(words, N_SHAPE) features of each word by itself."""
    a, b = trimmed(raw, start, end)
    kind = _KIND[raw]

    def count(bit: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((kind & bit) != 0, out=sums[1:])
        return sums[y] - sums[x]

    size = b - a
    digit, lower, upper, hexes = (count(bit, a, b) for bit in (1, 2, 4, 8))
    sign, quote, other, wide = (count(bit, s, e) for bit, s, e in ((16, start, end), (32, start, end), (64, a, b), (128, a, b)))
    runs = np.zeros(len(raw) + 1, np.int32)  # changes of character kind
    np.cumsum(np.r_[False, kind[1:] & 7 != kind[:-1] & 7], out=runs[1:])
    turns = runs[np.maximum(b, a + 1)] - runs[np.minimum(a + 1, len(raw))]
    key = np.isin(_word_hash(raw, a, b), _KEYS)
    step = np.searchsorted(_EDGES, size, side="right")
    columns = [step == i for i in range(6)] + [
        key, sign > 0, quote > 0, other > 0, wide > 0, size == 0,
        (digit == size) & (size > 0), (lower == size) & (size > 0), (upper == size) & (size > 0),
        (upper == 1) & (lower == size - 1), (digit > 0) & (lower + upper > 0),
        (digit > 0) & (lower > 0) & (upper > 0), (digit + hexes == size) & (size >= 8),
        (digit + lower + upper == size) & (size >= 16), 4 * turns >= size, 8 * turns >= size,
        3 * digit >= size, np.ones(len(start), bool)]
    return np.stack(columns, axis=1).astype(np.float32)


def emissions(raw: np.ndarray, start: np.ndarray, end: np.ndarray, word_text: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``features(...) @ w`` without laying the features out."""
    own = shapes(raw, start, end)
    parts = own @ np.hstack([w[i * N_SHAPE:(i + 1) * N_SHAPE] for i in range(3)]).astype(np.float32)
    e = parts[:, :3].astype(np.float64)
    same = word_text[1:] == word_text[:-1]
    e[1:][same] += parts[:-1, 3:6][same]
    e[:-1][same] += parts[1:, 6:][same]
    return e + (file_features(own, word_text) @ w[3 * N_SHAPE:])[word_text]


def file_features(own: np.ndarray, word_text: np.ndarray) -> np.ndarray:
    """(texts, N_FILE)."""
    texts = word_text[-1] + 1 if len(word_text) else 0
    total = np.maximum(np.bincount(word_text, minlength=texts), 1)
    signs = np.bincount(word_text, weights=own[:, 7], minlength=texts) / total
    keys = np.bincount(word_text, weights=own[:, 6], minlength=texts)
    return np.stack([signs > 0.02, signs > 0.2, keys > 0, total < 50], axis=1).astype(np.float32)


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, word_text: np.ndarray) -> np.ndarray:
    """(words, N_FEATURES): own shape, both neighbours', and the file's. ``word_text``: text of each word."""
    own = shapes(raw, start, end)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = word_text[1:] == word_text[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.hstack([own, before, after, file_features(own, word_text)[word_text]])


# --- the model --------------------------------------------------------------------

def train(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 3) and transitions (3, 3) of padded windows (windows, words, features)."""
    w, t = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    moments = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)]
    n, size = mask.shape
    hot = np.eye(3)[y] * mask[..., None]
    pair = np.einsum("nij,nik->jk", hot[:, :-1], hot[:, 1:])
    seen = np.einsum("nsf,nsj->fj", x, hot)
    for step in range(1, STEPS + 1):
        e = x @ w
        forward, backward = np.zeros((size, n, 3)), np.zeros((size, n, 3))
        forward[0] = e[:, 0]
        for i in range(1, size):
            new = np.logaddexp.reduce(forward[i - 1][:, :, None] + t, axis=1) + e[:, i]
            forward[i] = np.where(mask[:, i, None], new, forward[i - 1])
        for i in range(size - 2, -1, -1):
            new = np.logaddexp.reduce((backward[i + 1] + e[:, i + 1])[:, None, :] + t, axis=2)
            backward[i] = np.where(mask[:, i + 1, None], new, backward[i + 1])
        z = np.logaddexp.reduce(forward[-1], axis=1)
        p = np.exp(forward + backward - z[None, :, None]) * mask.T[..., None]
        both = np.zeros((3, 3))
        for i in range(1, size):
            q = np.exp(forward[i - 1][:, :, None] + t + (e[:, i] + backward[i])[:, None, :] - z[:, None, None])
            both += (q * mask[:, i, None, None]).sum(axis=0)
        grads = [(seen - np.einsum("nsf,snj->fj", x, p)) / n - DECAY * w, (pair - both) / n - DECAY * t]
        for k, (value, g) in enumerate(zip((w, t), grads)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            value += RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """Best labels of emissions (words, 3), between fixed neighbours if there are any."""
    score = e[0] + (t[before] if before is not None else 0)
    back = []
    for row in e[1:]:
        all_ = score[:, None] + t
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0) + row
    if after is not None:
        score = score + t[:, after]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def decode(e: np.ndarray, t: np.ndarray, word_text: np.ndarray) -> np.ndarray:
    """Viterbi labels of all words of many texts.

    Turning the end of a run of not-outside words to outside changes the score by at
    least minus the sum of (gap + 2 * slack) over it. So on a best path a word is not
    outside only if such a sum, from it to some later word of its text, isn't negative.
    """
    label = np.zeros(len(e), np.int64)
    if not len(e):
        return label
    slack = max(0.0, float((t - t[O, O]).max()))
    w = np.maximum(e[:, B], e[:, I]) - e[:, O] + 2 * slack + 1e-6
    sums = np.cumsum(np.r_[0, w])
    edge = np.flatnonzero(np.r_[True, word_text[1:] != word_text[:-1], True])
    possible = np.zeros(len(e), bool)
    part = np.searchsorted(edge, np.flatnonzero(w > 0), side="right") - 1
    for k in np.unique(part):  # a text without a positive word has no such sum
        a, b = edge[k], edge[k + 1]
        best = np.maximum.accumulate(sums[a + 1:b + 1][::-1])[::-1]
        possible[a:b] = best - sums[a:b] >= 0
    opens = np.zeros(len(e) + 1, bool)
    opens[edge] = True
    before = np.r_[False, possible[:-1]]
    start = np.flatnonzero(possible & (~before | opens[:-1]))
    end = np.flatnonzero(possible & (~np.r_[possible[1:], False] | opens[1:])) + 1
    for a, b in zip(start, end):
        label[a:b] = viterbi(e[a:b], t, None if opens[a] else O, None if opens[b] else O)
    return label


def layout(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(bytes, word start, word end, text of each word, byte offset of each text)."""
    raws = [t.encode() for t in texts]
    flat = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    offset = np.cumsum(np.r_[0, [len(r) + 1 for r in raws]])
    start, end = word_bounds(flat)
    return flat, start, end, np.searchsorted(offset, start, side="right") - 1, offset


def code_points(text: str) -> np.ndarray | None:
    """Code point at each byte offset; None if they are the same."""
    if text.isascii():
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])


def model_spans(texts: list[str], base: list[list[tuple]], w: np.ndarray, t: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) in code points of the model's spans that touch no base span."""
    raw, start, end, word_text, offset = layout(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(start):
        return out
    e = emissions(raw, start, end, word_text, w)
    label = decode(e, t, word_text)
    hit = np.flatnonzero(label != O)
    if not len(hit):
        return out
    a, b = trimmed(raw, start, end)
    opens = hit[(label[hit] == B) | ~np.isin(hit - 1, hit) | (word_text[hit] != word_text[hit - 1])]
    marks = set(opens.tolist())
    spans: list[list[int]] = []
    for i in hit.tolist():
        if i in marks:
            spans.append([i, i])
        else:
            spans[-1][1] = i
    for i, j in spans:
        k = int(word_text[i])
        x, y = int(a[i] - offset[k]), int(b[j] - offset[k])
        at = code_points(texts[k])
        if at is not None:
            x, y = int(at[x]), int(at[y])
        if y > x and not any(s < y and x < u for s, _, u, _ in base[k]):
            out[k].append((x, y))
    return out


def text_windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Windows of one text (features, labels, mask; padded at the end), labelled by its pattern spans: at most
    ``PER_TEXT`` around a span's first word and two around words outside."""
    raw, start, end, word_text, _ = layout([text])
    if not len(start):
        return None
    own = shapes(raw, start, end)
    y = np.zeros(len(start), np.int64)
    back = None if text.isascii() else np.flatnonzero(np.r_[True, (raw[1:] & 0xC0) != 0x80])
    for _, _, u, s in base_spans(text):
        s, u = (s, u) if back is None else (back[s], back[u])
        inside = np.flatnonzero((end > s) & (start < u))
        y[inside] = np.where(y[inside] == O, I, y[inside])
        y[inside[:1]] = B
    size = 2 * SIDE + 1
    # long letter-digit words that no pattern finds are left unlabelled: windows with one teach nothing
    doubtful = own[:, 3:6].any(axis=1) & (own[:, 16] > 0) & (own[:, 9] == 0) & (y == O)
    sums = np.cumsum(np.r_[0, doubtful])
    at = np.arange(len(y))
    calm = sums[np.minimum(at + SIDE + 1, len(y))] == sums[np.maximum(at - SIDE, 0)]
    middles = np.r_[spread(np.flatnonzero((y == B) & calm), PER_TEXT), spread(np.flatnonzero((y == O) & calm), 2)]
    at = middles[:, None] + np.arange(-SIDE, SIDE + 1)
    inside = (at >= 0) & (at < len(y))
    # padding moves to the end, so that a mask is a prefix
    order = np.argsort(~inside, axis=1, kind="stable")
    at, inside = np.take_along_axis(np.clip(at, 0, len(y) - 1), order, 1), np.take_along_axis(inside, order, 1)
    assert at.shape[1] == size
    # as ``features``, for the windows' words only
    before = own[np.maximum(at - 1, 0)] * (at > 0)[..., None]
    after = own[np.minimum(at + 1, len(y) - 1)] * (at < len(y) - 1)[..., None]
    file = np.broadcast_to(file_features(own, word_text)[0], (*at.shape, N_FILE))
    x = np.concatenate([own[at], before, after, file], axis=2)
    return x * inside[..., None], y[at] * inside, inside


def spread(places: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the places, evenly."""
    return places[::max(1, -(-len(places) // most))]


def windows(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Training windows of all texts' windows, at most MAX_WINDOWS with a secret and as many without. None without
    spans."""
    if not parts:
        return None
    x, y, mask = (np.concatenate(v) for v in zip(*parts))
    secret = (y == B).any(axis=1)
    if not secret.any():
        return None
    keep = np.r_[spread(np.flatnonzero(secret), MAX_WINDOWS), spread(np.flatnonzero(~secret), MAX_WINDOWS)]
    return x[keep].astype(np.float64), y[keep], mask[keep]


def fitted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights learnt from at most MAX_FIT texts with a pattern span, and as many without, of all rows. Only hashes
    are sorted; what comes to the driver of the texts with the least ones is their windows."""
    rows = docs.where("_text IS NOT NULL").select(F.xxhash64("_id", "_text").alias("h"), "_text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            spans = [bool(base_spans(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.bool_())], ["h", "spans"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (w := text_windows(text)) is not None and len(w[0]):
                    columns = [[h], [w[0].astype(np.float32).tobytes()], [w[1].astype(np.int64).tobytes()], [w[2].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "x", "y", "mask"])

    seen = landed(rows.mapInArrow(look, "h bigint, spans boolean"))
    least = [[r.h for r in seen.where(part).select("h").distinct().orderBy("h").limit(MAX_FIT).collect()]
             for part in ("spans", "NOT spans")]
    freed(seen)
    if not least[0]:
        return None
    order = {h: k for k, h in enumerate(least[0] + least[1])}
    made = rows.where(F.col("h").isin(list(order))).dropDuplicates(["h"]).mapInArrow(cut, "h bigint, x binary, y binary, mask binary")
    size = 2 * SIDE + 1
    parts = [(np.frombuffer(r.x, np.float32).reshape(-1, size, N_FEATURES), np.frombuffer(r.y, np.int64).reshape(-1, size),
              np.frombuffer(r.mask, bool).reshape(-1, size)) for r in sorted(made.collect(), key=lambda r: order[r.h])]
    made = windows(parts)
    return None if made is None else train(*made)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, ``n_assign``, ``n_access``, ``n_hex``, ``n_crf``, ``found`` (kind, start,
    end; code points, end exclusive) and ``redacted`` (the text with each span replaced by ``[secret]``); with
    ``digests`` ``base_sha256`` and ``spans`` instead. ``keep``: further columns of ``df`` to pass through."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)],
                     F.col(f"`{text_col}`").alias("_text"))
    learnt = fitted(docs)
    sent = docs.sparkSession.sparkContext.broadcast(learnt)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text"]
    tail = ["base_sha256 string", "spans string"] if digests else \
        ["found array<struct<kind:string,start:bigint,end:bigint>>", "redacted string"]
    counts = [f"n_{k} bigint" for k in KINDS]
    docs_columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(docs_columns) - 1):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            base = [base_spans(t) for t in texts]
            extra = model_spans(texts, base, *sent.value) if sent.value else [[]] * len(texts)
            every = [sorted([(s, k, e) for s, k, e, _ in b] + [(s, 3, e) for s, e in x]) for b, x in zip(base, extra)]
            named = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)
            columns = [*batch.columns[:-1], *(pa.array([sum(k == j for _, k, _ in r) for r in every], pa.int64()) for j in range(4))]
            if digests:
                columns += [pa.array([hashlib.sha256(named(r[:3] for r in b).encode()).hexdigest() for b in base]),
                            pa.array([named(r) for r in every], pa.string())]
            else:
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                columns += [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r] for r in every], kind),
                            pa.array([redact(t, r) for t, r in zip(texts, every)], pa.string())]
            names = batch.schema.names[:-1] + [x.split()[0] for x in counts + tail]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, ", ".join(fields + counts + tail))
    return out.withColumnsRenamed({"_id": id_col, **{f"k_{i}": c for i, c in enumerate(keep)}})


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[secret]"]
        at = e
    return "".join(out) + text[at:]


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"), digests=True)
