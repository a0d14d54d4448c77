"""Exact substring dedup over UTF-8 bytes by ranks at growing offsets.

A byte goes when it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id. As in prefix doubling,
strings are ranked by a short prefix, those that are alone with their rank drop out, and the rest are ranked again by pairs
of ranks at a greater offset, until the threshold length is reached:

1. GRAM-byte ranks. Every LENGTH-byte window is known by its anchor, the leftmost of its least-ranked GRAM-byte substrings,
   which depends on the window's content alone, so equal windows have equal anchors. Only anchors enter the sort (about one
   in 14 positions); an anchor that one document has alone drops out, with all windows it stands for.
2. The run of consecutive windows of one anchor is ranked as a whole. In all but the first document with a run, the run goes.
3. Anchors that are left with several different runs: their windows are parted by the anchor's place in them, STEP places a
   part, and a part is ranked by the LENGTH - STEP + 1 bytes that its windows have in common; parts that one document has alone
   drop out.
4. Every window of the parts that are left is ranked by the pair of its LENGTH/2-byte ranks at offsets 0 and LENGTH/2, and
   goes where an earlier document has the same pair.

Ranks are 64-bit codes of the content, so that sorting them needs no renumbering. Steps are joins and aggregations by rank
with partial minima; what gathers by document is bounded by the document.

Defined cases: null text is empty; texts under LENGTH bytes keep all; null ids match nothing and are no source; rows that
repeat a doc_id are no source for each other; other columns pass through remove(), which replaces text, n_bytes, n_removed,
n_spans and kept_sha256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import textcodes
from sluice.llm.common import Scratch, table

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
STEP = 7
PLACE = np.uint64((1 << 20) - 1)
SEGMENT = 1 << 19


def _views(texts: pa.Array):
    """(row, its bytes) of each text."""
    for first, last, data, offsets in textcodes.chunks(texts):
        for k in range(last - first):
            yield first + k, data[offsets[k] : offsets[k + 1]]


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = textcodes.powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def codes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content codes of the substrings from starts to ends."""
    _, down = textcodes.powers(len(sums))
    return textcodes.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * textcodes.STEPS[1])


def anchor_runs(data: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows and anchor's place in the first window of each run of windows with one anchor,
    for a whole text; runs also end every SEGMENT windows, at the cost of more anchors and no loss."""
    found = []
    windows = len(data) - LENGTH + 1
    for at in range(0, windows, SEGMENT):
        part = min(SEGMENT, windows - at) + LENGTH - GRAM
        starts = np.arange(at, at + part)
        keys = (codes(sums, starts, starts + GRAM) & ~PLACE) | (np.arange(part).astype(np.uint64) & PLACE)
        width = 1
        while 2 * width <= SPAN:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < SPAN:
            keys = np.minimum(keys[: len(keys) - (SPAN - width)], keys[SPAN - width :])
        place = (keys & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((keys[first] >> np.uint64(20), first + at, np.diff(np.append(first, len(keys))), place[first] - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors) of every document."""

    def run(batches):
        for batch in batches:
            own = []
            for _, data in _views(batch.column("text")):
                own.append(np.unique(anchor_runs(data, _sums(data))[0]).view(np.int64) if len(data) >= LENGTH else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "anchors"])

    return docs.mapInArrow(run, "doc_id long, anchors array<long>")


def _runs(docs: DataFrame) -> DataFrame:
    """(anchor, run, doc_id, start, n, place) of docs (doc_id, text, anchors): the runs with one of the given anchors."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            lists = batch.column("anchors")
            for row, data in _views(batch.column("text")):
                if len(data) < LENGTH:
                    continue
                sums = _sums(data)
                anchor, start, n, place = anchor_runs(data, sums)
                some = np.isin(anchor, lists[row].values.to_numpy(zero_copy_only=False).view(np.uint64))
                anchor, start, n, place = anchor[some], start[some], n[some], place[some]
                for column, values in zip(out, (anchor.view(np.int64), codes(sums, start, start + n + LENGTH - 1).view(np.int64), np.full(len(n), row), start, n, place), strict=True):
                    column.append(values)
            anchor, code, row, *rest = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(code), batch.column("doc_id").take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in rest)],
                ["anchor", "run", "doc_id", "start", "n", "place"],
            )

    return docs.select("doc_id", "text", "anchors").mapInArrow(run, "anchor long, run long, doc_id long, start int, n int, place int")


def _parts(docs: DataFrame) -> DataFrame:
    """(part, doc_id, start, n) of docs (doc_id, text, runs): the windows of each run by the anchor's place in them, STEP places
    a part, with the code of the bytes that all windows of such a part have in common."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            lists = batch.column("runs")
            for row, data in _views(batch.column("text")):
                sums, at = _sums(data), lists[row].values
                start, n, place = (at.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                inside = start + n + LENGTH - 1 <= len(data)  # rows that repeat a doc_id may be shorter
                start, n, anchor = start[inside], n[inside], (start + place)[inside]
                for low in range(0, SPAN, STEP):
                    high = min(low + STEP, SPAN) - 1  # the anchor is low..high bytes after the window's start
                    begin, end = np.maximum(start, anchor - high), np.minimum(start + n, anchor - low + 1)
                    some = begin < end
                    begin, end, own = begin[some], end[some], anchor[some]
                    for column, values in zip(out, (codes(sums, own - low, own - high + LENGTH).view(np.int64) + low, np.full(len(own), row), begin, end - begin), strict=True):
                        column.append(values)
            part, row, start, n = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), batch.column("doc_id").take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in (start, n))], ["part", "doc_id", "start", "n"]
            )

    return docs.select("doc_id", "text", "runs").mapInArrow(run, "part long, doc_id long, start int, n int")


def _windows(docs: DataFrame) -> DataFrame:
    """(head, tail, doc_id, start) of every window of the runs listed in docs (doc_id, text, runs)."""
    half = LENGTH // 2

    def run(batches):
        for batch in batches:
            heads, tails, rows, places = [], [], [], []
            lists = batch.column("runs")
            for row, data in _views(batch.column("text")):
                sums = _sums(data)
                at = lists[row].values
                start, n = (at.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                inside = start + n + LENGTH - 1 <= len(data)  # rows that repeat a doc_id may be shorter
                place = np.unique(np.concatenate([*(np.arange(a, a + m) for a, m in zip(start[inside], n[inside], strict=True)), np.zeros(0, np.int64)]))
                heads.append(codes(sums, place, place + half).view(np.int64))
                tails.append(codes(sums, place + half, place + LENGTH).view(np.int64))
                rows.append(np.full(len(place), row))
                places.append(place)
            head, tail, row, place = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (heads, tails, rows, places))
            yield pa.RecordBatch.from_arrays(
                [pa.array(head), pa.array(tail), batch.column("doc_id").take(pa.array(row)), pa.array(place)], ["head", "tail", "doc_id", "start"]
            )

    return docs.select("doc_id", "text", "runs").mapInArrow(run, "head long, tail long, doc_id long, start long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): starts and numbers of consecutive windows that an earlier document also has."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    every = scratch.keep(_anchors(docs))
    anchors = every.select(F.explode("anchors").alias("anchor"), "doc_id")
    several = scratch.keep(anchors.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    candidates = scratch.keep(anchors.join(several, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")))
    scratch.drop(every, several)
    runs = scratch.keep(_runs(docs.join(candidates, "doc_id")))
    scratch.drop(candidates)
    first = scratch.keep(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("first")))
    mixed = first.groupBy("anchor").agg(F.min("run").alias("x"), F.max("run").alias("y")).filter("x < y").select("anchor", F.lit(True).alias("mixed"))
    first_of = scratch.keep(first.join(mixed, "anchor", "left"))
    scratch.drop(first)
    later, span = F.col("doc_id") > F.col("first"), F.struct("start", "n")
    marks = scratch.keep(
        runs.join(first_of, ["anchor", "run"]).filter(later | F.col("mixed")).groupBy("doc_id")
        .agg(F.collect_list(F.when(later, span)).alias("later"), F.collect_list(F.when(~later, F.struct("start", "n", "place"))).alias("runs"))
    )
    scratch.drop(runs, first_of)
    parts = scratch.keep(_parts(docs.join(marks.filter(F.size("runs") > 0).select("doc_id", "runs"), "doc_id")))
    shared = parts.groupBy("part").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("part")
    open_ = scratch.keep(parts.join(shared, "part").groupBy("doc_id").agg(F.collect_list(span).alias("runs")))
    scratch.drop(parts)
    windows = scratch.keep(_windows(docs.join(open_, "doc_id")))
    scratch.drop(open_)
    least = windows.groupBy("head", "tail").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    partial = windows.join(least, ["head", "tail"]).filter("doc_id > first").select("doc_id", F.col("start").cast("int"), F.lit(1).alias("n"))
    partial = partial.groupBy("doc_id").agg(F.collect_list(span).alias("partial"))
    spans = scratch.keep(
        marks.select("doc_id", "later").join(partial, "doc_id", "full")
        .select("doc_id", F.concat(F.coalesce("later", F.array()), F.coalesce("partial", F.array())).alias("spans"))
    )
    scratch.drop(windows, marks)
    return spans


def remove(docs: DataFrame) -> DataFrame:
    """The rows of docs with kept (binary), n_bytes, n_removed, n_spans and kept_sha256."""
    spans = repeated_windows(docs)
    fields = [f for f in docs.schema.fields if f.name not in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    names = [f.name for f in fields]

    def cut(batches):
        for batch in batches:
            kept, size, gone, many, digest = [], [], [], [], []
            lists = batch.column("_spans")
            for row, data in _views(batch.column("text")):
                marks = np.zeros(len(data) + 1, np.int64)
                if lists[row].is_valid:
                    at = lists[row].values
                    start, n = (at.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                    inside = start + n + LENGTH - 1 <= len(data)
                    np.add.at(marks, start[inside], 1)
                    np.add.at(marks, (start + n + LENGTH - 1)[inside], -1)
                covered = np.cumsum(marks)[: len(data)] > 0
                kept.append(data[~covered].tobytes())
                size.append(len(data))
                gone.append(int(covered.sum()))
                many.append(int((covered[1:] & ~covered[:-1]).sum() + covered[:1].sum()))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            new = [pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (size, gone, many)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    return docs.select(*names).join(spans, F.col("doc_id") == F.col("_id"), "left").drop("_id").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
