"""Schemas of the engine's tables. A finding is one row; positions are flat columns."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = "struct<file:string,line:int,column:int>"
EDIT = f"struct<start:{POSITION},end:{POSITION},new_text:string>"
FIX = f"struct<message:string,edits:array<{EDIT}>>"
RELATED = f"struct<position:{POSITION},message:string>"

FINDING = f"seq long, linter string, message string, severity string, file string, line int, column int, source_lines array<string>, fixes array<{FIX}>, related array<{RELATED}>"
#: What most operators need of a finding.
CORE = ("linter", "message", "severity", "file", "line", "column")

RULE = "ordinal int, linters array<string>, path string, path_except string, text string, source string"
RANGE = "file string, from_line int, to_line int, col int, linters array<string>"
NODE = "file string, start_line int, end_line int, col int"
PACKAGE = "id string, path string, for_test string, files array<string>"
EDGE = "src string, dst string"
RUN = "run_id long, package string, mode string, go_files array<string>, compiles boolean"
OBSERVATION = "seq long, bucket string, v long"

SEVERITIES = ("error", "warning", "info")


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
