"""Records that cross line and split borders: quoted CSV and one-document JSON files read by many tasks.

A task that starts in the middle of a file cannot know whether it starts inside a quoted text. So every split first tells
where it ends for each state it may start in; a running composition over the splits of a file gives the true states, one
row per split; a second pass cuts records with the state known. Rows keep the order of the file inside a split, so no
pass shuffles text: only the pieces of records that cross a border, at most two per split, are put together after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise

_AT = ["file", "start"]
_STATES = "file string, start bigint, out_end boolean, in_end boolean, valid boolean, crlf boolean"
_PIECES = "file string, start bigint, place bigint, kind string, text binary"
_PIECE_SCHEMA = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("text", pa.binary())]
)


def _chunks(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """``(file, start, text)`` of all chunks between separators, in the order of the file inside each split."""
    return spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("text"),
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of chunks of one split; a split may come as several runs, one after the other."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        texts = batch.column("text").to_pylist()
        at = 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or (files[i], starts[i]) != (files[at], starts[at]):
                yield (files[at], starts[at]), texts[at:i]
                at = i


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [dict(zip(_PIECE_SCHEMA.names, r)) for r in rows], schema=_PIECE_SCHEMA
    )


def _join_pieces(pieces: DataFrame, glue: bytes) -> DataFrame:
    """``(file, start, place, text)``: whole records, and those put together from a tail, middles and a head.

    Pieces of one file are few: at most two per split.
    """
    whole = pieces.where("kind = 'whole'").select("file", "start", "place", "text")
    order = Window.partitionBy("file").orderBy("start", "place")
    parts = pieces.where("kind <> 'whole'").withColumn(
        "record", F.count_if(F.col("kind") == "tail").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    texts = F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "text"))), lambda x: x["text"])
    joined = parts.groupBy("file", "record").agg(
        F.min(F.struct("start", "place")).alias("at"),
        F.aggregate(F.slice(texts, 2, 1 << 30), F.get(texts, F.lit(0)), lambda a, b: F.concat(a, F.lit(glue), b)).alias("text"),
    )
    return whole.unionByName(joined.select("file", "at.start", "at.place", "text"))


# --- delimited text -------------------------------------------------------------------------------------------
_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')


def quoted_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open after a line, given whether one was open before it.

    A field is quoted if its first sign is a quote; two quotes inside are one; after the closing quote, and in fields that are not
    quoted, quotes mean nothing up to the next separator.
    """
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        close = _CLOSING.match(line, at)
        if close is None:
            return True
        inside = False
        at = line.find(sep, close.end())
        if at < 0:
            return False
        at += len(sep)


def csv_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> tuple[DataFrame, list[str]]:
    """``(file, text)`` of all records but the first of each file, its header, and the files that are not UTF-8.

    Lines end with a line feed, or, in files whose first line does, with a carriage return and a line feed, which become a
    line feed inside quotes; empty lines between records are none.
    """
    lines = _chunks(spark, path, "\n")
    states, mark = materialise(_line_states(lines, sep.encode())), sep.encode()
    other = [r["file"] for r in states.groupBy("file").agg(F.bool_and("valid").alias("v")).where("NOT v").collect()]
    # splits that start inside a quoted field: at most one entry per split
    inside = {(r["file"], r["start"]) for r in _starts(states).where("inside").select(*_AT).collect()}
    pairs = {r["file"] for r in states.where("start = 0 AND crlf").select("file").collect()}  # at most one entry per file
    sent = spark.sparkContext.broadcast((inside, pairs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, held, open_, first, place = None, [], False, False, 0
        out: list[tuple] = []

        def close(at) -> None:
            # lines that are left are the beginning of a record, or all of the split lies inside one
            if begun is not None and held:
                out.append((*at, place, "middle" if first else "tail", b"\n".join(held)))

        for at, texts in _by_split(batches):
            if at != begun:
                close(begun)
                begun, held, place = at, [], 0
                open_ = first = at in sent.value[0]
            if at[0] in sent.value[1]:
                texts = [line.removesuffix(b"\r") for line in texts]
            for line in texts:
                if not held and not open_ and not line:
                    continue
                held.append(line)
                open_ = quoted_after(line, open_, mark)
                if not open_:
                    out.append((*at, place, "head" if first else "whole", b"\n".join(held)))
                    held, first, place = [], False, place + 1
            if len(out) > 5000:
                yield _pieces(out)
                out.clear()
        close(begun)
        yield _pieces(out)

    records = _join_pieces(lines.mapInArrow(cut, _PIECES), b"\n")
    text = F.when(F.col("file").isin(other), F.decode("text", "ISO-8859-1")).otherwise(F.col("text").cast("string"))
    heads = _first_records(records)  # one row per file
    rest = records.join(F.broadcast(heads), ["file", "start", "place"], "left_anti")
    return rest.select("file", text.alias("text")), other


def _first_records(records: DataFrame) -> DataFrame:
    """The place of the first record of each file; one row per file."""
    return records.groupBy("file").agg(F.min(F.struct("start", "place")).alias("at")).select("file", "at.start", "at.place")


def _line_states(lines: DataFrame, sep: bytes) -> DataFrame:
    """For every split: whether a quoted field is open at its end, if none was at its start, and if one was."""

    schema = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("out_end", pa.bool_()), ("in_end", pa.bool_()), ("valid", pa.bool_()),
         ("crlf", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, ends, valid, crlf = None, [False, True], True, False
        row = lambda: pa.RecordBatch.from_pylist(
            [dict(zip(schema.names, (*begun, *ends, valid, crlf)))], schema=schema
        )
        for at, texts in _by_split(batches):
            if at != begun:
                if begun is not None:
                    yield row()
                begun, ends, valid, crlf = at, [False, True], True, texts[0].endswith(b"\r")
            for line in texts:
                if b'"' in line:
                    ends = [quoted_after(line, e, sep) for e in ends]
                if valid and not line.isascii():
                    try:
                        line.decode()
                    except UnicodeDecodeError:
                        valid = False
        if begun is not None:
            yield row()

    return lines.mapInArrow(run, _STATES)


def _starts(states: DataFrame) -> DataFrame:
    """``(file, start, inside)``: the state at the start of each split, by composing those before it.

    A split keeps the state, turns it over, or sets it. The state before a split is the one set last, turned over as
    often as later splits do.
    """
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("out_end") == F.col("in_end")
    turns = F.sum((F.col("out_end") & ~F.col("in_end")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = states.withColumns({"turns": turns, "sets": sets})
    last = F.last(F.when(F.col("sets"), F.struct("out_end", "turns")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last).withColumn("so_far", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    base = F.coalesce(F.col("last.out_end"), F.lit(False)).cast("int")
    turned = F.col("so_far") - F.coalesce(F.col("last.turns"), F.lit(0))
    return rows.select(*_AT, ((base + turned) % 2 == 1).alias("inside"))


def parse_csv(records: DataFrame, names: Sequence[str], sep: str = ",") -> DataFrame:
    """Records of text to text columns, as the reader of whole files does."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("text", schema, options).alias("r")).select("r.*")


# --- one JSON document per file ---------------------------------------------------------------------------------
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[[ord("{"), ord("[")]] = 1
_BRACKETS[[ord("}"), ord("]")]] = -1
_DEPTHS = "file string, start bigint, root string, odd boolean, out_delta bigint, in_delta bigint"


def _marks(octets: np.ndarray, text: bytes) -> np.ndarray:
    """Places of quotes that are not escaped. A backslash stands only in strings, so the state does not matter."""
    quotes = np.flatnonzero(octets == 0x22)
    if not (octets == 0x5C).any():
        return quotes
    kept = []
    for q in quotes.tolist():
        run = q
        while run and text[run - 1] == 0x5C:
            run -= 1
        if (q - run) % 2 == 0:
            kept.append(q)
    return np.array(kept, np.int64)


class _Text:
    """Structure of a stretch of JSON: its brackets, commas and colons outside strings, with their depths."""

    def __init__(self, text: bytes, inside: bool, depth: int):
        self.octets = np.frombuffer(text, np.uint8)
        quotes = _marks(self.octets, text)
        signs = np.flatnonzero((_BRACKETS[self.octets] != 0) | (self.octets == 0x2C))
        self.at = signs[(np.searchsorted(quotes, signs) + inside) % 2 == 0]
        self.sign = self.octets[self.at]
        step = _BRACKETS[self.sign].astype(np.int64)
        self.after = depth + np.cumsum(step)
        self.before = self.after - step
        self.inside = bool((len(quotes) + inside) % 2)
        self.depth = int(self.after[-1]) if len(step) else depth


def _depth_states(chunks: DataFrame) -> DataFrame:
    """For every split: its first sign, whether it turns the string state over, and its change of depth for either state."""
    schema = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("root", pa.string()), ("odd", pa.bool_()), ("out_delta", pa.int64()),
         ("in_delta", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, root, state, delta = None, "", [False, True], [0, 0]
        row = lambda: pa.RecordBatch.from_pylist(
            [dict(zip(schema.names, (*begun, root, state[0], *delta)))], schema=schema
        )
        for at, texts in _by_split(batches):
            joined = b",".join(texts) + b","
            if at != begun:
                if begun is not None:
                    yield row()
                begun, state, delta = at, [False, True], [0, 0]
                root = joined.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("ascii", "replace")
            for k in (0, 1):
                found = _Text(joined, state[k], 0)
                state[k], delta[k] = found.inside, delta[k] + found.depth
        if begun is not None:
            yield row()

    return chunks.mapInArrow(run, _DEPTHS)


def _depth_starts(states: DataFrame) -> DataFrame:
    """``(file, start, inside, depth, level)`` of each split; ``level`` is the depth at which the file's lists open."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = states.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    delta = F.when(F.col("inside"), F.col("in_delta")).otherwise(F.col("out_delta"))
    root = F.first("root").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("delta", delta).select(
        *_AT,
        "inside",
        F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"),
        F.when(root == "[", 0).otherwise(1).alias("level"),
    )


def _streamed(chunks: DataFrame, starts: dict, work) -> DataFrame:
    """Pieces from one worker per split, which reads the text of the split in order."""
    sent = chunks.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, worker = None, None
        for at, texts in _by_split(batches):
            if at != begun:
                if worker is not None:
                    yield _pieces(worker.done())
                begun, worker = at, work(at, *sent.value[at])
            yield _pieces(worker.read(b",".join(texts) + b","))
        if worker is not None:
            yield _pieces(worker.done())

    return chunks.mapInArrow(run, _PIECES)


class _Lists:
    """Where the lists of a split open and close, with the text that holds their key.

    ``since`` is the text after the last sign that a key may follow; a split that starts in the middle of a key has
    only its end, which the kind marks with a question mark.
    """

    def __init__(self, at, inside: bool, depth: int, level: int):
        self.at, self.inside, self.depth, self.level = at, inside, depth, level
        self.offset, self.since, self.known = 0, b"", False

    def read(self, text: bytes) -> list[tuple]:
        found, level, out = _Text(text, self.inside, self.depth), self.level, []
        opening = (found.sign == 0x5B) & (found.before == level)
        closing = (found.sign == 0x5D) & (found.after == level)
        keys = found.at[((found.sign == 0x2C) & (found.before == 1)) | ((found.sign == 0x7B) & (found.before == 0))]
        for spot, opens in zip(found.at[opening | closing].tolist(), opening[opening | closing].tolist()):
            if not opens or level == 0:
                out.append((*self.at, self.offset + spot, "open" if opens else "close", b""))
                continue
            last = int(np.searchsorted(keys, spot))
            key = text[keys[last - 1] + 1 : spot] if last else self.since + text[:spot]
            out.append((*self.at, self.offset + spot, "open" if last or self.known else "open?", key))
        if len(keys):
            self.since, self.known = text[keys[-1] + 1 :], True
        else:
            self.since += text
        if found.depth != 1 or level == 0:
            self.since = b""
        self.inside, self.depth, self.offset = found.inside, found.depth, self.offset + len(text)
        return out

    def done(self) -> list[tuple]:
        if self.depth != 1 or self.level == 0:
            return []
        return [(*self.at, self.offset, "since" if self.known else "since?", self.since)]


class _Elements:
    """The elements between the opening and the closing bracket of the chosen list that lie in a split."""

    def __init__(self, chosen: dict, at, inside: bool, depth: int, level: int):
        self.at, self.inside, self.depth, self.level = at, inside, depth, level
        self.offset, self.held, self.place = 0, [], 0
        first, last = chosen.get(at[0], ((-1, -1), (-1, -1)))
        # offsets inside this split between which elements lie, None where the list goes on to its end
        self.low = first[1] + 1 if first[0] == at[1] else 0
        self.high = last[1] if last[0] == at[1] else None
        self.skip = first[0] > at[1] or last[0] < at[1]
        self.fresh = first[0] == at[1]  # the first element here begins here

    def read(self, text: bytes) -> list[tuple]:
        found, out, size = _Text(text, self.inside, self.depth), [], len(text)
        ended = self.high is not None and self.high < self.offset
        if not self.skip and not ended and self.low < self.offset + size:
            low = max(0, self.low - self.offset)
            here = self.high is not None and self.high < self.offset + size
            high = self.high - self.offset if here else size
            ends = found.at[(found.sign == 0x2C) & (found.before == self.level + 1)]
            ends = ends[(ends >= low) & (ends < high)].tolist()
            for end in ends + ([high] if here else []):
                self.held.append(text[low:end])
                out.append((*self.at, self.place, "whole" if self.fresh else "head", b"".join(self.held)))
                self.held, self.fresh, self.place, low = [], True, self.place + 1, end + 1
            if not here:
                self.held.append(text[low:high])
        self.inside, self.depth, self.offset = found.inside, found.depth, self.offset + size
        return out

    def done(self) -> list[tuple]:
        # what is left goes on after the comma that ended this split
        if not self.held:
            return []
        return [(*self.at, self.place, "tail" if self.fresh else "middle", b"".join(self.held))]


def _chosen(events: DataFrame, records_key: str | None) -> dict[str, tuple]:
    """For each file the places of the brackets around its list: one entry per file."""
    opens = events.where("kind <> 'close'")
    if records_key is not None:
        # a key that began in an earlier split goes on after the comma that ended it
        order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
        run = F.count_if(~F.col("kind").endswith("?")).over(order)
        so_far = Window.partitionBy("file", "run").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
        words = F.array_join(F.collect_list(F.col("text").cast("string")).over(so_far), "")
        name = F.from_json(F.concat(F.lit("["), F.regexp_replace(words, r":\s*$", ""), F.lit("]")), "array<string>")
        opens = opens.withColumn("run", run).withColumn("key", F.get(name, F.lit(0)))
        opens = opens.where((F.col("key") == records_key) | F.col("root_list"))
    place = F.struct("start", "place")
    first = opens.where("kind LIKE 'open%'").groupBy("file").agg(F.min(place).alias("first"))
    closes = events.where("kind = 'close'").select("file", place.alias("last"))
    ranges = first.join(closes, "file").where(F.col("last") > F.col("first")).groupBy("file").agg(
        F.first("first").alias("first"), F.min("last").alias("last")
    )
    return {r["file"]: (tuple(r["first"]), tuple(r["last"])) for r in ranges.collect()}


def json_records(spark: SparkSession, path: str, records_key: str | None = None) -> tuple[DataFrame, list[str]]:
    """``(file, text)`` of the elements of one list per file, and the files that have none.

    The list is the root, or the value of ``records_key`` in the root object, by default of its first key with a list.
    """
    chunks = _chunks(spark, path, ",")
    states = _depth_starts(_depth_states(chunks)).collect()  # one row per split
    starts = {(r["file"], r["start"]): (r["inside"], r["depth"], r["level"]) for r in states}
    roots = [r["file"] for r in states if r["level"] == 0 and r["start"] == 0]
    events = _streamed(chunks, starts, _Lists).withColumn("root_list", F.col("file").isin(roots))
    chosen = _chosen(materialise(events), records_key)
    pieces = _streamed(chunks, starts, lambda *at: _Elements(chosen, *at))
    records = _join_pieces(pieces, b"").select("file", F.col("text").cast("string").alias("text"))
    files = {f for f, _ in starts}
    return records.where(F.col("text").rlike(r"\S")), sorted(files - set(chosen))
