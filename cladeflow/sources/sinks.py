"""Distances as matrices and files."""

from __future__ import annotations

import gzip
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame


def matrix_array(pairs: DataFrame, n: int, dtype: type) -> np.ndarray:
    """The symmetric matrix of (i, j, dist) with i < j; its n * n cells must fit the driver, as the caller asked for them all."""
    t = pairs.select("i", "j", "dist").toArrow()
    i, j, d = (t.column(k).to_numpy() for k in ("i", "j", "dist"))
    m = np.zeros((n, n), dtype)
    m[i, j] = d
    m[j, i] = d
    return m


def matrix_lists(pairs: DataFrame, n: int, whole: bool) -> list[list]:
    return matrix_array(pairs, n, np.int64 if whole else np.float64).tolist()


def matrix_bytes(pairs: DataFrame, n: int) -> bytes:
    """Row after row as native 32-bit unsigned integers."""
    return matrix_array(pairs, n, np.uint32).tobytes()


def format_number(x: float) -> str:
    """Shortest decimal digits, without an exponent, without a point where the number is whole."""
    return np.format_float_positional(float(x), unique=True, trim="-")


def write_matrix_tsv(path: str, names: Sequence[str], matrix: Sequence[Sequence[float]]) -> None:
    """A labelled table, tab-separated; gzip where the path ends in .gz, standard output where it is "-"."""
    lines = (["\t".join(["", *names])] + ["\t".join([name, *map(format_number, row)]) for name, row in zip(names, matrix, strict=True)])
    text = "".join(f"{x}\n" for x in lines)
    if path == "-":
        sys.stdout.write(text)
    elif path.endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8", newline="") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def write_pairs(pairs: DataFrame, path: str, compression: str = "snappy") -> None:
    """Distances in long form as Parquet: for more trees than a matrix can be collected for."""
    pairs.write.option("compression", compression).parquet(path)
