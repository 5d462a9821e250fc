"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a document with up to ``e = m * rate``
edits. Cut into e + 1 pieces, at least one piece then stands there unchanged. One
automaton finds all pieces of a block of items in one pass over a text; a hit
gives the window in which the item may stand, windows of one item that touch are
joined, and Myers' bit-parallel edit distance verifies each.

The benchmark is the query set: items are taken in blocks of bounded size and
each block is held against all documents; nothing of the documents is shuffled.
Texts are compared with letters lower-cased (where that keeps the length) and
white space squeezed to single spaces.

Items of under ``MIN_CHARS`` characters leave no room for an edit: they are found word
for word, at word boundaries (no letter or digit goes on at either end). Null or
empty items are left out; null or empty documents hold none. Every repeated item and
every repeated document row gets its rows; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import landed, sliced, table

RATE = 0.05
MIN_CHARS = 20
BLOCK_CHARS = 1_000_000  # characters of the items in a block


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def origins(text: str) -> list[int]:
    """Offset in the text of every character of normal(text), and of its end."""
    out, low, gap = [], lowered(text), None
    for i, c in enumerate(low):
        if c.isspace():
            gap = i if gap is None and out else gap
        else:
            if gap is not None:
                out.append(gap)
                gap = None
            out.append(i)
    return out + [out[-1] + 1 if out else 0]


def budget(size: int, rate: float) -> int:
    return int(size * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of about equal length."""
    cuts = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def stands_alone(text: str, a: int, b: int) -> bool:
    """No word goes on across either end of text[a:b]."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()
                or b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


class Pattern:
    """An item and its bit masks, for distances by Myers' algorithm."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)
        self.mask: dict[str, int] = {}
        for i, c in enumerate(text):
            self.mask[c] = self.mask.get(c, 0) | 1 << i

    def ends(self, text: str, most: int) -> list[tuple[int, int]]:
        """(end, distance) wherever a substring that ends there is within ``most`` edits."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance = full, 0, self.size
        get, out = self.mask.get, []
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(xh | plus) & full
            down = plus & xh
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(xv | up) & full
            minus = up & xv
            if distance <= most:
                out.append((j + 1, distance))
        return out


class Block:
    """Automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            errors = 0 if len(text) < MIN_CHARS else budget(len(text), rate)
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((key, Pattern(text), Pattern(text[::-1]), errors))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item key, distance, start, end, places) of every item found; its best place, the first of equals."""
        if not self.items or not text:
            return []
        spots: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begin = last + 1 - size - at
                spots.setdefault(k, []).append((begin, begin + self.items[k][1].size))
        out = []
        for k, windows in sorted(spots.items()):
            key, pattern, mirrored, errors = self.items[k]
            if pattern.size < MIN_CHARS:
                whole = [(a, b) for a, b in windows if stands_alone(text, a, b)]
                if whole:
                    out.append((key, 0, *min(whole), len(whole)))
                continue
            found, joined = [], []
            for a, b in sorted(windows):
                a, b = max(0, a - errors), min(len(text), b + errors)
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            places = 0
            for a, b in joined:
                ends = pattern.ends(text[a:b], errors)
                found += [(d, a + j) for j, d in ends]
                previous = None
                for j, _ in ends:  # neighbouring ends belong to one place
                    places += previous is None or j - previous > pattern.size // 2
                    previous = j
            if found:
                distance, end = min(found)
                back = mirrored.ends(text[max(0, end - pattern.size - errors):end][::-1], errors)
                size = min(j for j, d in back if d == distance)
                out.append((key, distance, end - size, end, places))
        return out


_blocks: dict[str, Block] = {}


def item_blocks(items: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The normalised items, some at a time: blocks of about ``block_chars`` characters by the item's hash."""
    wanted = items.select(F.col(f"`{item_col}`").alias("k"), F.col(f"`{item_text_col}`").alias("t")).where("t IS NOT NULL")
    chars = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for number in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == number).orderBy("k", "t").collect()
        yield [(r.k, n) for r in rows if (n := normal(r.t))]


def block_in_worker(spark: SparkSession, items: list[tuple], rate: float) -> Callable[[], Block]:
    """Builds the automaton of a block once in each Python worker, which holds one block at a time."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Block:
        if name not in _blocks:
            _blocks.clear()
            _blocks[name] = Block(sent.value, rate)
        return _blocks[name]

    return get


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item key, ``distance``, ``start``, ``end``, ``n_places``): one row per document and item found in
    it, with the best place in code points of the document's text."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kinds = [df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, distance int, start bigint, `end` bigint, n_places int"
    found = []
    for block in item_blocks(items, item_col, item_text_col, block_chars):
        if found:  # of several blocks each is written once, before the next
            found[-1] = landed(found[-1])
        found.append(scan_block(docs, block_in_worker(docs.sparkSession, block, rate), schema))
    return reduce(DataFrame.unionAll, found)


def scan_block(docs: DataFrame, block: Callable[[], Block], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            out = []
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                if text and (found := block().matches(normal(text))):
                    at = origins(text)
                    out += [(key.as_py(), k, d, at[a], at[b - 1] + 1, n) for k, d, a, b, n in found]
            if out:
                columns = list(zip(*out))
                target = [batch.schema.field(0).type, None, pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target)],
                                                 [x.split()[0].strip("`") for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def without_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, all columns, whose text holds no item. No shuffle."""
    at, first = df.columns.index(text_col), True
    for items_ in item_blocks(items, item_col, item_text_col, block_chars):
        df = df if first else landed(df)
        df, first = clean_rows(df, block_in_worker(df.sparkSession, items_, rate), at), False
    return df


def clean_rows(df: DataFrame, block: Callable[[], Block], at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            ok = [not (t and block().matches(normal(t))) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in every whole text of ``documents``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
