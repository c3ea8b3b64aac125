"""From file contents to symbols, imports, calls and types: one row for each file, with arrays whose order is meaningful."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plexgraph.sources.parsers import go, python, rest, ruby, script

#: array column -> its fields; ``line`` fields are integers, lists end with ``[]``, booleans with ``?``.
FIELDS = {
    "symbols": "name kind start_line end_line content signature class_name decorators[]",
    "imports": "module names[] is_relative? alias",
    "calls": "name line receiver arguments[] is_weak_ref?",
    "type_refs": "name kind line param_name",
    "heritage": "class_name kind parent_name",
    "exports": "",
    "variable_types": "var_name type_name line",
    "endpoints": "url_pattern http_method function_name line",
    "http_calls": "url http_method line receiver",
}
PARSERS = {"python": python.parse, "typescript": script.parse, "tsx": script.parse, "javascript": script.parse, "ruby": ruby.parse, "go": go.parse}


def _arrow(field: str) -> pa.Field:
    if field.endswith("[]"):
        return pa.field(field[:-2], pa.list_(pa.string()))
    if field.endswith("?"):
        return pa.field(field[:-1], pa.bool_())
    return pa.field(field, pa.int32() if field.endswith("line") else pa.string())


_ARROW = {k: pa.list_(pa.struct([_arrow(f) for f in v.split()]) if v else pa.string()) for k, v in FIELDS.items()}


def _sql(field: str) -> str:
    if field.endswith("[]"):
        return f"{field[:-2]}: array<string>"
    return f"{field[:-1]}: boolean" if field.endswith("?") else f"{field}: {'int' if field.endswith('line') else 'string'}"


SCHEMA = "path string, language string, content string, " + ", ".join(f"{k} array<{'struct<' + ', '.join(map(_sql, v.split())) + '>' if v else 'string'}>" for k, v in FIELDS.items())


def parse(content: str, language: str) -> dict[str, list]:
    """What a file holds; a file that can't be parsed holds nothing."""
    out: dict[str, list] = {k: [] for k in FIELDS}
    try:
        out |= PARSERS[language](content)
    except (SyntaxError, ValueError, RecursionError, KeyError):
        pass
    return out | rest.extract(content, language)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        content, language = b.column(1).to_pylist(), b.column(2).to_pylist()
        rows = [parse(c or "", x or "") for c, x in zip(content, language)]
        columns = [b.column(0), b.column(2), b.column(1), *[pa.array([r[k] for r in rows], _ARROW[k]) for k in FIELDS]]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "language", "content", *FIELDS])


def parsed(files: DataFrame) -> DataFrame:
    """The parse result of each file (path, content, language); files are independent, so tasks parse them in parallel."""
    return files.select("path", "content", "language").mapInArrow(_parsed, SCHEMA)
