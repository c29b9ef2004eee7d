"""Scalar functions on file names, tree headers and tree text. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATION = r"\[&[^\]]*(?:\]|\z)"


def strip_annotations(text: Column) -> Column:
    """Without what stands from "[&" to the next "]" (or to the end); other brackets stay."""
    return F.regexp_replace(text, ANNOTATION, "")


def strip_beast_annotations(text: str) -> str:
    """strip_annotations for one string."""
    return re.sub(r"\[&[^\]]*(?:\]|\Z)", "", text)


def base_name(path: Column) -> Column:
    """The file name without any ".trees" at its end; "unknown" where there is none."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.trees)+$", "")
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def name_state(header: Column) -> Column:
    """struct(name, state) of a tree header: its second word and the digits after the first STATE_ in any
    case; ("", 0) where the header has no blank, no second word, no STATE_ or no usable digits after it."""
    rest = F.regexp_extract(header, r"(?s)^[^ ]* (.*)$", 1)
    name = F.regexp_extract(rest, r"^\s*(\S+)", 1)
    digits = F.regexp_extract(header, r"(?is)^.*?STATE_(\d*)", 1)
    value = F.when(digits != "", digits).try_cast("decimal(20,0)")
    fits = value.isNotNull() & (value <= F.lit("18446744073709551615").cast("decimal(20,0)")) & (name != "")
    zero = F.lit(0).cast("decimal(20,0)")
    return F.struct(F.when(fits, name).otherwise(F.lit("")).alias("name"), F.when(fits, value).otherwise(zero).alias("state"))


def tree_name(base: Column, name: Column, file_idx: Column | None = None) -> Column:
    """base_name, with file{idx}_ ahead of it where files are numbered."""
    out = F.concat_ws("_", base, name)
    return out if file_idx is None else F.concat(F.lit("file"), file_idx.cast("string"), F.lit("_"), out)


def burn_in(idx: Column, state: Column, trees: int, states: int) -> Column:
    """Whether a tree is kept: past the first `trees`, or of a state greater than `states`; a test given as 0 does not apply."""
    if not trees and not states:
        return F.lit(True)
    keep = F.lit(False)
    if trees:
        keep = keep | (idx >= trees)
    if states:
        keep = keep | (state > F.lit(states).cast("decimal(20,0)"))
    return keep
