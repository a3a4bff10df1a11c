"""External analyzers: programs that read paths and write findings as JSON lines."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ARGUMENT_BYTES = 96 * 1024


def chunks(args: list[str], most: int = ARGUMENT_BYTES) -> list[list[str]]:
    """Greedy, in order: each argument counts its bytes and one more."""
    out: list[list[str]] = []
    room = 0
    for a in args:
        n = len(a.encode()) + 1
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(a)
        room -= n
    return out


def run(files: DataFrame, argv: list[str], timeout: float = 60.0, most: int = ARGUMENT_BYTES) -> DataFrame:
    """Starts the program for chunks of each partition's files (file): value, exit_code, error.

    A timeout is exit code 124; a non-zero exit is told, not raised, so that the caller decides.
    """

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in chunks(batch["file"].tolist(), most):
                try:
                    p = subprocess.run([*argv, *some], capture_output=True, text=True, timeout=timeout, check=False)
                    lines, code, error = p.stdout.splitlines(), p.returncode, p.stderr
                except subprocess.TimeoutExpired:
                    lines, code, error = [], 124, "timeout"
                yield pd.DataFrame({"value": [*lines, None], "exit_code": [0] * len(lines) + [code], "error": [None] * len(lines) + [error or None]})

    return files.select("file").mapInPandas(start, "value string, exit_code int, error string")


def outcome(output: DataFrame) -> tuple[int, str | None]:
    """The largest exit code, and of the errors of the program's runs the last in byte order."""
    from pyspark.sql import functions as F

    r = output.agg(F.max("exit_code").alias("code"), F.max("error").alias("error")).first()
    return r["code"] or 0, r["error"]
