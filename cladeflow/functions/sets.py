"""Leaf sets as sorted arrays of ranks 0 .. n-1, and packed as bits where a byte order is wanted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(split: Column, n: Column) -> Column:
    """The ranks below n that are not in split."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0), n.cast("int") - 1), split)).otherwise(split)


def canonical_side(split: Column, n: Column) -> Column:
    """Of a split and its complement the one without rank 0."""
    return F.when(F.array_contains(split, 0), complement(split, n)).otherwise(split)


def set_union(a: Column, b: Column) -> Column:
    """The sorted ranks in either."""
    return F.array_sort(F.array_union(a, b))


def packed(split: Column, n: Column) -> Column:
    """A split as bits: ceil(n / 64) words of 64 bits as big-endian bytes, rank r being bit r % 64 of word r / 64.

    A leaf costs one bit instead of an integer, and bytes compare as the sets do: word by word, unsigned.
    """
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 64).cast("int"), F.lit(1)) - 1), lambda w: _word(split, w))
    return F.unhex(F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _word(split: Column, w: Column) -> Column:
    own = F.filter(split, lambda r: F.floor(r / 64) == w)
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, r: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (r % 64).cast("int"))))


def _words(bits: Column) -> Column:
    """The words of packed bits as longs; the upper half of a word is read apart, as a word may exceed a signed long."""
    count = F.octet_length(bits) / 8
    half = lambda at: F.conv(F.hex(F.substring(bits, at, F.lit(4))), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda w: F.call_function("shiftleft", half(w * 8 + 1), F.lit(32)).bitwiseOR(half(w * 8 + 5)))


def count_ones(bits: Column) -> Column:
    """The size of a packed set."""
    return F.aggregate(F.transform(_words(bits), F.bit_count), F.lit(0), lambda a, x: a + x)


def packed_union(a: Column, b: Column) -> Column:
    """The union of two packed sets of one length."""
    both = F.zip_with(_words(a), _words(b), lambda x, y: x.bitwiseOR(y))
    return F.unhex(F.array_join(F.transform(both, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


class Bitset:
    """A set of small whole numbers in a fixed number of 64-bit words; ordered word by word, unsigned."""

    __slots__ = ("words",)

    def __init__(self, words: Iterable[int]) -> None:
        self.words = list(words)

    @classmethod
    def zeros(cls, n_words: int) -> Bitset:
        return cls([0] * n_words)

    @classmethod
    def for_leaves(cls, n: int) -> Bitset:
        return cls.zeros(-(-n // 64))

    def set(self, i: int) -> None:
        self.words[i >> 6] |= 1 << (i & 63)

    def or_assign(self, other: Bitset) -> None:
        self.words = [a | b for a, b in zip(self.words, other.words, strict=True)]

    def count_ones(self) -> int:
        return sum(w.bit_count() for w in self.words)

    def members(self) -> list[int]:
        return [64 * k + i for k, w in enumerate(self.words) for i in range(64) if w >> i & 1]

    def to_bytes(self) -> bytes:
        """Big-endian words, so that bytes compare as the sets do."""
        return b"".join(w.to_bytes(8, "big") for w in self.words)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bitset) and self.words == other.words

    def __lt__(self, other: Bitset) -> bool:
        return self.words < other.words

    def __hash__(self) -> int:
        return hash(tuple(self.words))

    def __repr__(self) -> str:
        return f"Bitset({self.members()})"
