"""One large file read by many tasks (S1, S2): byte ranges parsed from their true state.

A CSV record may hold line breaks inside quotes, a JSON array is one value: neither can be cut without knowing what
stands before. Both are read in two passes over Spark's own splittable text source, cut at every line break (CSV) or
comma (JSON), with the file and the start of the byte range of each piece:

1. each range is summed up for both states that it may begin in (outside or inside quotes): the state that it ends in
   and, for JSON, the brackets that it closes and opens and its commas by relative depth. Summaries compose
   associatively; a scan over them, one small row for each range that the driver plans anyway, gives every range its
   true state;
2. each range is parsed from that state. What crosses a range's end is emitted in parts, at most two for each range,
   and put together by a small grouping.

So a file of any size is read by as many tasks as it has ranges (``spark.sql.files.maxPartitionBytes``), and no task
holds more than a batch of pieces and one record.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .records import records_from_items

QUOTE, BACKSLASH, COMMA = b'"\\,'
_SPACE = b" \t\r\n"


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, block, value): the pieces of files between separators, in order within (file, block), the byte range."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("value"))


def paths_of(spark: SparkSession, path: str | list[str]) -> dict[int, str]:
    """Name of each input file by its hash; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    return {r.file: r.path for r in files.select("path", F.xxhash64("path").alias("file")).collect()}


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, list[bytes]]]:
    """(file, block, whether the range begins here, pieces) of rows (file, block, value)."""
    last = None
    for batch in batches:
        file, block = (batch.column(k).to_numpy() for k in (0, 1))
        turn = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *turn], [*turn, len(file)]):
            if b > a:
                key = int(file[a]), int(block[a])
                yield *key, key != last, batch.column(2).slice(a, b - a).to_pylist()
                last = key


def joined_parts(rows: DataFrame, separator: str) -> DataFrame:
    """Rows with ``part`` 0 as they are; a row with part 1 goes on in the rows of part 2 that follow it in its file, up
    to the next of part 1. Only these parts are shuffled."""
    order = Window.partitionBy("path").orderBy("block", "seq")
    parts = rows.where("part > 0").withColumn("_turn", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    first = [F.min_by(c, F.struct("block", "seq")).alias(c) for c in rows.columns if c not in ("path", "text", "part")]
    text = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    whole = parts.groupBy("path", "_turn").agg(*first, F.array_join(text["text"], separator).alias("text"))
    return rows.where("part = 0").drop("part").unionByName(whole.drop("_turn"))


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, rec_pos, record) of rows (path, block, seq, record): records are numbered within their range, and a
    range's numbers start after those of the ranges before it."""
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("seq"))
    return rows.withColumn("_place", place).join(F.broadcast(starts), ["path", "block"]).select(
        F.col("path").alias("doc_id"), (F.col("_before") + F.col("_place") - 1).alias("rec_pos"), "record")


# --- CSV ---------------------------------------------------------------------

_FIELD_START = re.compile(rb'[,\r]"')
_FIELD_END = re.compile(rb"[,\r]")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted field. A quote opens only at the start of a field; two in a row are one."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            at += 1
            if line.startswith(b'"', at):
                at += 1
                continue
            end = _FIELD_END.search(line, at)
            if not end:
                return False
            inside, at = False, end.end()
        if line.startswith(b'"', at):
            inside, at = True, at + 1
            continue
        start = _FIELD_START.search(line, at)
        if not start:
            return False
        inside, at = True, start.end()


def cut_returns(record: bytes) -> list[bytes]:
    """A record whose unquoted carriage returns end records of their own."""
    body = record[:-1] if record.endswith(b"\r") else record
    if b"\r" not in body:
        return [body]
    out, inside, held = [], False, b""
    for part in body.split(b"\r"):
        held = held + b"\r" + part if inside else part
        inside = ends_inside(part, inside)
        if not inside:
            out.append(held)
    return [*out, held] if inside else out


def parsed(records: list[bytes]) -> list[list[str]]:
    """Fields of CSV records, as Python's reader sees them."""
    csv.field_size_limit(2**31 - 1)
    return list(csv.reader([r.decode("utf-8", "replace") for r in records]))


def _csv_states(lines: DataFrame) -> dict[tuple[int, int], tuple[bool, list[str] | None]]:
    """(file, block) -> (whether it begins inside quotes, the file's header)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[int, int], list] = {}  # of the ranges of this task
        for file, block, _, values in by_range(batches):
            state = ends.setdefault((file, block), [False, True, None, []])
            for line in values:
                if b'"' in line:
                    state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
                if block == 0 and state[2] is None:  # the file's first record, for its header
                    state[3].append(line)
                    if not state[0] and line not in (b"", b"\r"):
                        state[2] = parsed(cut_returns(b"\n".join(state[3]).lstrip(b"\r\n"))[:1])[0]
        if ends:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in ends]), pa.array([k[1] for k in ends]), pa.array([v[0] for v in ends.values()]),
                 pa.array([v[1] for v in ends.values()]), pa.array([v[2] for v in ends.values()], pa.list_(pa.string()))],
                ["file", "block", "outside", "inside", "header"])

    rows = lines.mapInArrow(run, "file bigint, block bigint, outside boolean, inside boolean, header array<string>").collect()
    out, inside, header = {}, False, None
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.block == 0:
            inside, header = False, r.header
        if header is None and r.block > 0:
            raise ValueError("a CSV header must end within the first byte range of its file")
        out[r.file, r.block] = inside, header
        inside = r.inside if inside else r.outside
    return out


def csv_file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S2 on files of any size: (doc_id, rec_pos, record), ``doc_id`` the file's path.

    Rows equal Python's ``csv.DictReader``: quoted line breaks and doubled quotes, blank lines skipped, missing fields
    null, of repeated header names the last; fields beyond the header are left out. A lone carriage return outside
    quotes ends a record. An empty file, or one with a header alone, has no records."""
    lines = pieces(spark, path, "\n")
    states = spark.sparkContext.broadcast((_csv_states(lines), paths_of(spark, path)))
    names = ["path", "block", "seq", "part", "header", "text", "fields"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_, paths = states.value
        held: list[bytes] = []  # lines of an open record
        inside, part, seq, here, first = False, 0, 0, None, False

        def rows(part: int, records: list[bytes]) -> list[tuple]:
            nonlocal seq, first
            key, header = (paths[here[0]], here[1]), states_[here][1]
            if header is None:  # nothing but a header that never ends
                return []
            if part:
                out = [(*key, seq, part, header, records[0].decode("utf-8", "replace"), None)]
                seq += 1
                return out
            out = []
            for fields in parsed(records):
                if not fields:
                    continue
                if first:  # the header
                    first = False
                    continue
                out.append((*key, seq, 0, header, None, fields))
                seq += 1
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for file, block, begins, values in by_range(batches):
            out: list[tuple] = []
            if begins:
                if held:
                    out += rows(part or 1, [b"\n".join(held)])
                here, held, seq = (file, block), [], 0
                inside, first = states_[here][0], block == 0
                part = 2 if inside else 0  # the range begins within a record of an earlier one
            whole: list[bytes] = []
            for line in values:
                held.append(line)
                if inside or b'"' in line:
                    inside = ends_inside(line, inside)
                if inside:
                    continue
                if part:
                    out += rows(2, [b"\n".join(held)])
                    part = 0
                else:
                    whole += cut_returns(b"\n".join(held))
                held = []
            out += rows(0, whole)
            if out:
                yield batch_of(out)
        if held:
            if out := rows(part or 1, [b"\n".join(held)]):
                yield batch_of(out)

    schema = ("path string, block bigint, seq bigint, part int, header array<string>, text string, fields array<string>")
    rows = written(lines.mapInArrow(run, schema))
    merged = joined_parts(rows.where("part > 0").drop("fields"), "\n")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            fields = pa.array([parsed([t.encode()])[0] for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), fields], ["path", "block", "seq", "header", "fields"])

    split = merged.select("path", "block", "seq", "header", "text").mapInArrow(
        parse, "path string, block bigint, seq bigint, header array<string>, fields array<string>")
    all_rows = rows.where("part = 0").select("path", "block", "seq", "header", "fields").unionByName(split)
    return numbered(all_rows.select("path", "block", "seq", record_of("header", "fields").alias("record")))


def record_of(header: str, fields: str) -> Column:
    """JSON object of a header and a row; of repeated names the last value, missing ones null."""
    names = F.array_distinct(header)
    last = F.transform(names, lambda k: F.size(header) - F.array_position(F.reverse(F.col(header)), k))
    values = F.transform(last, lambda at: F.try_element_at(F.col(fields), (at + 1).cast("int")))
    return F.to_json(F.map_from_arrays(names, values), {"ignoreNullFields": "false"})


# --- JSON --------------------------------------------------------------------

@dataclass
class Structure:
    """Brackets of a stretch outside strings: how many it closes that it has not opened, those it leaves open, and its
    commas by depth relative to its start."""

    pops: int = 0
    pushed: bytes = b""
    commas: Counter = field(default_factory=Counter)

    def then(self, other: Structure) -> Structure:
        kept = max(0, len(self.pushed) - other.pops)
        shift = len(self.pushed) - self.pops
        return Structure(self.pops + max(0, other.pops - len(self.pushed)), self.pushed[:kept] + other.pushed,
                         self.commas + Counter({d + shift: n for d, n in other.commas.items()}))


def quotes(d: np.ndarray) -> np.ndarray:
    """Mask of the quotes that no backslash escapes."""
    quote = d == QUOTE
    slash = d == BACKSLASH
    if slash.any():
        at = np.flatnonzero(quote[1:] & slash[:-1]) + 1
        place = np.arange(len(d))
        before = np.maximum.accumulate(np.where(slash, -1, place))  # last other byte up to each place
        quote[at[(at - 1 - before[at - 1]) % 2 == 1]] = False
    return quote


def strings(d: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """(mask of bytes outside strings, whether the stretch ends inside one)."""
    parity = np.cumsum(quotes(d)) + inside
    return parity % 2 == 0, bool(parity[-1] % 2) if len(d) else inside


def steps(d: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """1 at an opening bracket outside strings, -1 at a closing one."""
    kind = d | 32  # [ ] become { }
    return np.where(outside, (kind == 123).astype(np.int64) - (kind == 125), 0)


def structure(d: np.ndarray, inside: bool) -> Structure:
    """Summary of a stretch that begins outside or inside a string."""
    outside, _ = strings(d, inside)
    step = steps(d, outside)
    depth = np.cumsum(step)
    low = int(min(0, depth.min(initial=0)))
    later = np.minimum.accumulate(depth[::-1])[::-1]
    # an opening bracket stays open if the depth never falls below its own again
    left = np.flatnonzero((step == 1) & (later >= depth) & (depth > low))
    at, count = np.unique(depth[(d == COMMA) & outside], return_counts=True)
    return Structure(-low, d[left].tobytes(), Counter(dict(zip(at.tolist(), count.tolist()))))


@dataclass
class State:
    """Where a range begins: in a string or not, within which brackets, after how many commas of the outermost one."""

    inside: bool
    stack: bytes
    items: int
    bad: bool = False

    @property
    def at_cut(self) -> bool:
        """Whether the comma before the range parts two items."""
        return not self.inside and (len(self.stack) == 1 or self.stack[1:] == b"[")


def _json_states(parts: DataFrame) -> dict[tuple[int, int], State]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for file, block, _, values in by_range(batches):
            d = np.frombuffer(b",".join(values) + b",", np.uint8)
            state = sums.setdefault((file, block), [False, Structure(), Structure()])
            each = structure(d, False), structure(d, True)
            state[1], state[2] = state[1].then(each[state[0]]), state[2].then(each[not state[0]])
            state[0] ^= strings(d, False)[1]
        for (file, block), (flips, *both) in sums.items():
            cells = [[c] for c in (file, block, flips)]
            for s in both:
                cells += [[s.pops], [s.pushed], [list(s.commas)], [list(s.commas.values())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)

    side = [("pops", pa.int64()), ("pushed", pa.binary()), ("depths", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    fields = [("file", pa.int64()), ("block", pa.int64()), ("flips", pa.bool_()), *[(f"{n}{h}", k) for h in (0, 1) for n, k in side]]
    names, kinds = [n for n, _ in fields], [k for _, k in fields]
    ddl = {"int64": "bigint", "bool": "boolean", "binary": "binary"}
    schema = ", ".join(f"{n} {ddl.get(str(k), 'array<bigint>')}" for n, k in fields)
    out: dict[tuple[int, int], State] = {}
    ends: dict[int, tuple[State, State]] = {}
    state, first = State(False, b"", 0), None
    for r in sorted(parts.mapInArrow(run, schema).collect(), key=lambda r: (r.file, r.block)):
        if r.block == 0:
            state = first = State(False, b"", 0)
        out[r.file, r.block] = state
        h = int(state.inside)
        depth = len(state.stack)
        items = dict(zip(r[f"depths{h}"], r[f"counts{h}"])).get(1 - depth, 0)
        state = State(state.inside ^ r.flips, state.stack[:max(0, depth - r[f"pops{h}"])] + bytes(r[f"pushed{h}"]), state.items + items,
                      state.bad or r[f"pops{h}"] > depth)
        ends[r.file] = first, state
    for first, last in ends.values():
        first.bad |= last.bad or last.inside or bool(last.stack)  # closes too much, or not all
    return out


class Cutter:
    """Cuts a range into segments: what stands between the outermost brackets, the brackets of arrays in them, and the
    commas in either."""

    def __init__(self, state: State) -> None:
        self.inside, self.depth, self.items = state.inside, len(state.stack), state.items
        self.array = state.stack[1:2] == b"["
        self.top = state.stack[:1]
        self.open: list[bytes] = []  # of the segment that is being read
        self.level, self.lead, self.item = self.depth, b"," if state.stack else b"", state.items
        self.part = 0 if state.at_cut or not state.stack and not state.inside else 2

    def cut(self, buffer: bytes) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
        """(part, item, level, lead, text, end) of the segments that end in the buffer: lead and end are the bytes that
        stand before and after."""
        d = np.frombuffer(buffer, np.uint8)
        outside, inside = strings(d, self.inside)
        step = steps(d, outside)
        depth = self.depth + np.cumsum(step)
        second = np.maximum.accumulate(np.where((step == 1) & (depth == 2), np.arange(len(d)), -1))
        in_array = np.where(second >= 0, d[second] == 91, self.array)
        comma = (d == COMMA) & outside & ((depth == 1) | ((depth == 2) & in_array))
        opens = (step == 1) & ((depth == 1) | ((depth == 2) & (d == 91)))
        closes = (step == -1) & ((depth == 0) | ((depth == 1) & (d == 93)))
        at = 0
        for p in np.flatnonzero(comma | opens | closes).tolist():
            end = buffer[p:p + 1]
            text = b"".join([*self.open, buffer[at:p]])
            yield self.part, self.item, self.level, self.lead, text, end
            self.open, self.part, at = [], 0, p + 1
            self.level, self.lead = int(depth[p]), end
            if comma[p] and self.level == 1:
                self.items += 1
            if opens[p] and self.level == 1:
                self.top = end
            self.item = self.items
        self.open.append(buffer[at:])
        self.inside, self.depth = inside, int(depth[-1]) if len(d) else self.depth
        self.array = bool(in_array[-1]) if len(d) else self.array


def _misplaced(level: int, lead: bytes, text: bytes, end: bytes, top: bytes) -> bool:
    """Whether a whole segment can't stand where it does: text outside the outermost brackets, nothing between commas,
    something before or after an array without a comma."""
    after = lead.decode()
    if level == 0:
        return bool(text.strip(_SPACE) or after)
    if text.strip(_SPACE):
        return after == "]" or end == b"[" and top == b"["
    return after == "," and end in b",]}" or after in ("[", "{") and end == b","


def json_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, seq, top, item, level, lead, text, bad) of JSON files: the items of an outermost array and the
    members of an outermost object (level 1), the items of arrays in either (level 2). ``bad``: not JSON."""
    parts = pieces(spark, path, ",")
    states = spark.sparkContext.broadcast((_json_states(parts), paths_of(spark, path)))
    names = ["path", "block", "seq", "part", "top", "item", "level", "lead", "text", "bad"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_, paths = states.value
        cutter, here, seq = None, (0, 0), 0

        def row(part, item, level, lead, text, bad):
            nonlocal seq
            seq += 1
            decoded = [x.decode("utf-8", "replace") for x in (cutter.top, lead, text)]
            return (paths[here[0]], here[1], seq, part, decoded[0], item, level, decoded[1], decoded[2], bad)

        def rest() -> list[tuple]:
            """The segment that goes on in the next range, or the end of the file."""
            text = b"".join(cutter.open)[:-1]  # without the comma that ends the range's last piece
            if cutter.level == 0 and not cutter.part:
                text = text.rstrip(_SPACE)
                if not text and not cutter.lead:
                    return []
            elif not text and cutter.lead == b"," and not cutter.part:
                return []  # it ended with a cut
            return [row(cutter.part or 1, cutter.item, cutter.level, cutter.lead, text, False)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for file, block, begins, values in by_range(batches):
            out: list[tuple] = []
            if begins:
                if cutter:
                    out += rest()
                here, seq = (file, block), 0
                cutter = Cutter(states_[here])
                if states_[here].bad:
                    out.append(row(0, 0, 0, b"", b"", True))
            for part, item, level, lead, text, end in cutter.cut(b",".join(values) + b","):
                bad = not part and _misplaced(level, lead, text, end, cutter.top)
                if part or bad or text.strip(_SPACE) or lead != b"," and cutter.top == b"{":
                    out.append(row(part, item, level, lead, text, bad))
            if out:
                yield batch_of(out)
        if cutter and (out := rest()):
            yield batch_of(out)

    schema = ("path string, block bigint, seq bigint, part int, top string, item bigint, level int, lead string, "
              "text string, bad boolean")
    rows = written(parts.mapInArrow(run, schema))
    return joined_parts(rows, ",")


def json_file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S1 on files of any size: (doc_id, rec_pos, record), ``doc_id`` the file's path.

    The same rows as ``json_records`` gives for a document: of a list its objects and the rows of its tables (an item
    that is a list whose first element is a list: a header and rows, each row read by a task of its own range); of an
    object the items of its first member that is a list starting with an object, else the object itself. A file that is
    not JSON, or holds none, gives nothing. Of repeated keys of an outermost object the first list counts."""
    cells = json_segments(spark, path).withColumn("body", F.trim(F.regexp_replace("text", r"[\t\r\n]+", " ")))
    cells = written(cells)
    spot = ["path", "item"]
    member = F.col("top") == "{"
    # not JSON: structure, or an item or member that is none
    shown = (F.when(member & (F.col("level") == 1) & F.col("body").endswith(":"), F.concat(F.lit("{"), F.col("body"), F.lit("0}")))
             .when(member & (F.col("level") == 1), F.concat(F.lit("{"), F.col("body"), F.lit("}")))
             .otherwise(F.col("body")))
    wrong = F.col("bad") | (F.col("body") != "") & ((F.col("level") == 0) | F.try_parse_json(shown).isNull())
    bad = written(cells.where(wrong).select("path").distinct())
    fine = cells.where("body != ''").join(bad, "path", "left_anti")
    # the header of a table; the first member of an object that is a list starting with an object
    second = fine.where("level = 2")
    firsts = second.where("lead = '['")
    headers = firsts.where("top = '[' AND body LIKE '[%'").select(*spot, F.col("body").alias("header"))
    chosen = firsts.where("top = '{' AND body LIKE '{%'").groupBy("path").agg(F.min("item").alias("item"))
    place = ["path", "block", "seq"]
    items = fine.where("top = '[' AND level = 1").select(*place, F.col("body").alias("item_text"))
    table = F.concat(F.lit("["), F.col("header"), F.lit(","), F.col("body"), F.lit("]"))
    rows = _small_side(second.where("top = '[' AND lead = ','"), headers, spot).select(*place, table.alias("item_text"))
    listed = _small_side(second.where("top = '{'"), chosen, spot).select(*place, F.col("body").alias("item_text"))
    texts = F.from_json(F.concat(F.lit("["), F.col("item_text"), F.lit("]")), "array<string>")
    variants = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("item_text"), F.lit("]"))), "$", "array<variant>")
    found = items.unionByName(rows).unionByName(listed).select(*place, texts.alias("texts"), variants.alias("items"))
    found = found.select(*place, F.posexplode(records_from_items(F.col("texts"), F.col("items"))).alias("at", "r"))
    found = found.select("path", "block", F.struct("seq", "at").alias("seq"), F.col("r.record").alias("record"))
    # objects that are a record themselves
    lone = cells.where("top = '{'").join(bad, "path", "left_anti").join(chosen.select("path"), "path", "left_anti")
    pieces_ = F.array_sort(F.collect_list(F.struct("block", "seq", F.concat("lead", "body").alias("text"))))
    whole = F.from_json(F.concat(F.lit("["), F.array_join(pieces_["text"], ""), F.lit("]")), "array<string>")
    itself = lone.groupBy("path").agg(whole[0].alias("record")).select(
        "path", F.lit(0).cast("long").alias("block"), F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).alias("at")).alias("seq"), "record")
    return numbered(found.unionByName(itself))


#: Rows of a looked-up side up to which it is broadcast.
MAX_LOOKUP = 100_000


def _small_side(rows: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Join with a side that has one row for each table or file: broadcast up to a checked number of rows, since one
    table may hold all rows; with more, no key is that hot and rows are joined by shuffle."""
    lookup = written(lookup)
    return rows.join(F.broadcast(lookup) if lookup.count() <= MAX_LOOKUP else lookup, on)
