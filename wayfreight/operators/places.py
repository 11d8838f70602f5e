"""Where rewrites touch a file: each hit with its place in the source and in the rewritten text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions.text import contains_any
from wayfreight.operators.classify import file_facts
from wayfreight.operators.rewrite import PYTHON_TYPES

#: (label, pattern, replacement) of each rule in its order, by kind of file.
RULES = {
    "streamlit": [(f"ui: {old}", re.escape(old), new) for old, new in rules.UI_REWRITES],
    "python": [
        ("py: from snowflake.snowpark import", rules.PY_IMPORT_PATTERN, rules.PY_IMPORT_TARGET),
        *((f"py: {old}", re.escape(old), new) for old, new in rules.PY_REWRITES),
    ],
}
_FIELDS = {
    "app_id": pa.string(), "path": pa.string(), "rule": pa.string(), "line": pa.int32(), "column": pa.int32(), "length": pa.int32(),
    "target_column": pa.int32(),
}
_SCHEMA = "app_id string, path string, rule string, line int, column int, length int, target_column int"


class OffsetMap:
    """Which characters of a line stand for which stretch of the source, through ordered replacements."""

    def __init__(self, text: str):
        self.text = text
        self.origin = [(i, i + 1) for i in range(len(text))]

    def replace(self, pattern: str, new: str) -> list[tuple[int, int]]:
        """Replace all hits; their places in the source. A hit in replaced text has all of that text's place."""
        places, text, origin, done = [], [], [], 0
        for hit in re.finditer(pattern, self.text):
            a, b = hit.span()
            place = min(o[0] for o in self.origin[a:b]), max(o[1] for o in self.origin[a:b])
            places.append(place)
            text += [self.text[done:a], new]
            origin += self.origin[done:a] + [place] * len(new)
            done = b
        self.text = "".join(text) + self.text[done:]
        self.origin = origin + self.origin[done:]
        return places

    def target(self, place: tuple[int, int]) -> int:
        """Where the text that stands for a place begins."""
        return next(i for i, (a, b) in enumerate(self.origin) if a <= place[0] and place[1] <= b)


def line_hits(kind: str, line: str) -> list[tuple[str, int, int, int]]:
    """(rule, column, length, target column) of each hit in a line, rules in order, columns from 1 in characters."""
    offsets, found = OffsetMap(line), []
    for label, pattern, new in RULES[kind]:
        found += [(label, *place) for place in offsets.replace(pattern, new)]
    return [(label, a + 1, b - a, offsets.target((a, b)) + 1) for label, a, b in found]


def _hit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for app, path, kind, number, line in zip(*(batch.column(c).to_pylist() for c in ("app_id", "path", "kind", "line", "text"))):
            rows += [(app, path, label, number, *hit) for label, *hit in line_hits(kind, line)]
        columns = zip(*rows) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values())], names=list(_FIELDS))


def rewrite_places(files: DataFrame) -> DataFrame:
    """One row for each replacement: app_id, path, rule, line, column, length, target_column.

    Places are those of the source: a rule that finds what an earlier one wrote touches the source of that.
    No rule reaches over the end of a line or writes one, so the line is the same before and after, and each line
    is looked at by itself; only lines that hold a part of some rule leave Spark. ``target_column`` is in the
    rewritten line, before a helper or anything else is put in front of the text. Totals equal
    :func:`wayfreight.operators.rewrite.rewrite_hits`. Nothing is shuffled. Empty files and files of other types
    give no row; lines end at a line feed, a carriage return belongs to its line.
    """
    candidates = files.filter(contains_any(F.col("content"), rules.REWRITE_PARTS))
    guarded = F.col("type").isin(*PYTHON_TYPES) & F.col("content").contains(rules.PY_REWRITE_GUARD)
    kind = F.when(F.col("type") == "streamlit", "streamlit").when(guarded, "python")
    typed = file_facts(candidates, keep_content=True).filter("is_component").select("app_id", "path", kind.alias("kind"), "content")
    lines = typed.filter("kind IS NOT NULL").select("app_id", "path", "kind", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    wanted = lines.filter(contains_any(F.col("text"), rules.REWRITE_PARTS))
    return wanted.select("app_id", "path", "kind", (F.col("pos") + 1).cast("int").alias("line"), "text").mapInArrow(_hit_batches, _SCHEMA)
