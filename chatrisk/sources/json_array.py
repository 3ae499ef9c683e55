"""Datasets kept as one JSON array: a scan that splits the file at record boundaries.

The separator is `}`: a record is an object, so it ends where that sign closes depth 2 outside a string. A split's
summary has the parity of its quotes, which is the same whatever stands before it, and the change of depth for either
state of the string at its start. Records inside a split are parsed where they stand; only the two broken ends of a
split are shuffled and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatrisk.sources.pieces import earlier, per_split, read_pieces, summed_up, with_starts

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_FIRST = re.compile(r"﻿?\s*\[\s*")
_NEXT = re.compile(r"\s*,\s*(?=\{)")
_LAST = re.compile(r"\s*\]\s*\Z")


def scanned(text: str, inside: bool) -> tuple[bool, int]:
    """(whether the text ends inside a string, change of depth), for a text that begins inside a string or not."""
    parts = _ESCAPE.sub("", text).split('"')  # escapes stand in strings only; what is left of quotes is real
    plain = "".join(parts[inside::2])
    return inside ^ (len(parts) % 2 == 0), sum(map(plain.count, "{[")) - sum(map(plain.count, "}]"))


def split_summary(first: bool, pieces: Iterator[str]) -> Iterator[tuple]:
    """(odd number of quotes, change of depth from outside, change of depth from inside a string)."""
    states, depths = [False, True], [0, 0]
    for k, piece in enumerate(pieces):
        text = piece if first and k == 0 else "}" + piece
        for start in (0, 1):
            states[start], change = scanned(text, states[start])
            depths[start] += change
    yield states[0], depths[0], depths[1]


def split_records(first: bool, pieces: Iterator[str], inside: bool, depth: int) -> Iterator[tuple]:
    """(json, begins, ends) of the records of a split; one that began before it has no beginning, one that goes on
    behind it no end."""
    parts, begins = ([], False) if depth > 1 else (None, True)
    for k, piece in enumerate(pieces):
        if first and k == 0:
            rest = piece
            head = _FIRST.match(rest)
            if not head:
                raise ValueError(f"not a JSON array: {rest[:80]!r}")
            depth, rest = 1, rest[head.end():]
        else:
            rest = piece
            if inside or depth > 2:
                depth -= not inside
                parts.append("}")
            elif depth == 2:
                yield "".join([*parts, "}"]), begins, True
                parts, depth = None, 1
                follows = _NEXT.match(rest)
                rest = rest[follows.end():] if follows else rest
                if not follows and not _LAST.match(rest):
                    raise ValueError(f"neither a record nor the end of the array: {rest[:80]!r}")
            else:
                raise ValueError(f"a closing brace outside a record: {rest[:80]!r}")
        if depth == 1 and parts is None:
            if not rest.startswith("{"):
                if not _LAST.match(rest):
                    raise ValueError(f"not a record: {rest[:80]!r}")
                depth = 0
                continue
            parts, begins = [], True
        elif depth == 0 and rest.strip():
            raise ValueError(f"text behind the array: {rest[:80]!r}")
        if parts is not None:
            parts.append(rest)
            inside, change = scanned(rest, inside)
            depth += change
            if depth < 2 and not inside:
                raise ValueError(f"a record is not closed: {rest[:80]!r}")
    if parts is not None:
        yield "".join(parts), begins, False


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON array files as rows of `schema`; broken JSON is an error.

    The first pass runs at once. One record must fit into a row.
    """
    pieces = read_pieces(spark, path, "}")
    splits = summed_up(pieces, split_summary, "odd BOOLEAN, from_out INT, from_in INT")
    quotes = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier()), F.lit(0))
    opened = splits.withColumn("inside", quotes % 2 == 1).withColumn("change", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")))
    starts = opened.withColumn("depth", F.coalesce(F.sum("change").over(earlier()), F.lit(0)).cast("int"))
    broken = starts.groupBy("file").agg(F.sum("change").alias("depth"), F.sum(F.col("odd").cast("int")).alias("n")).filter("depth != 0 OR n % 2 = 1")
    if files := [r.file for r in broken.limit(3).collect()]:
        raise ValueError(f"JSON arrays that are not closed: {files}")
    known = with_starts(pieces, starts.select("file", "block", "inside", "depth"))
    found = per_split(known, split_records, "json STRING, begins BOOLEAN, ends BOOLEAN", ["inside", "depth"])
    whole = found.filter("begins AND ends").select("json")
    # Two parts of a split at most; a record is the parts from one beginning to the next.
    place = Window.partitionBy("file").orderBy("block", F.col("begins"))
    parts = found.filter("NOT (begins AND ends)").withColumn("record", F.sum(F.col("begins").cast("int")).over(place))
    joined = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "begins", "json"))).alias("parts"))
    rows = whole.unionByName(joined.select(F.array_join("parts.json", "").alias("json")))
    return rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
