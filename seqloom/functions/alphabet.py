"""Alphabets, and column expressions over sequences and their encodings.

Sequences stay strings; an encoding is ``array<array<float>>``, one row per symbol, and unknown
symbols are rows of 1/N. Everything here is a built-in expression and stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """An ordered set of symbols, the unknown symbol, complements, and whether lower case counts."""

    symbols: str
    unknown: str
    complements: dict[str, str] = field(default_factory=dict)
    any_case: bool = True

    def ordered(self, symbols: str) -> Alphabet:
        """The same alphabet in another order; no global state changes."""
        if sorted(symbols) != sorted(self.symbols):
            raise ValueError(f"not an order of {self.symbols}: {symbols}")
        return Alphabet(symbols, self.unknown, self.complements, self.any_case)

    def folded(self, seq: Column) -> Column:
        return F.upper(seq) if self.any_case else seq


DNA = Alphabet("ACGT", "N", {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"})
# The twenty amino acids in the order of the protein encoding.
PROTEIN = Alphabet("ARNDCEQGHILKMFPSTWYV", "X", any_case=False)


def symbols(seq: Column) -> Column:
    """The characters of a string as an array; none for the empty string."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def one_hot(seq: Column, alphabet: Alphabet = DNA) -> Column:
    """One row per symbol, 1 at its place; 1/N everywhere for unknown ones."""
    even = F.lit(1.0 / len(alphabet.symbols)).cast("float")
    bases = [F.lit(b) for b in alphabet.symbols]
    known = F.lit(alphabet.symbols)

    def row(c):
        here = F.contains(known, c)
        return F.array(*[F.when(~here, even).when(c == b, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float") for b in bases])

    return F.transform(symbols(alphabet.folded(seq)), row)


def decode(encoding: Column, alphabet: Alphabet = DNA) -> Column:
    """The first symbol whose value is exactly 1, else the unknown one."""
    bases = F.array(*[F.lit(b) for b in alphabet.symbols])
    one = F.lit(1.0).cast("float")

    def symbol(row):
        at = F.array_position(F.transform(row, lambda v: v.cast("float") == one), F.lit(True))
        return F.when(at > 0, F.get(bases, (at - 1).cast("int"))).otherwise(F.lit(alphabet.unknown))

    return F.array_join(F.transform(encoding, symbol), "")


def reverse_complement(seq: Column, alphabet: Alphabet = DNA) -> Column:
    """Upper-case reverse complement; raises on symbols without a complement."""
    old, new = "".join(alphabet.complements), "".join(alphabet.complements.values())
    bad = seq.rlike(f"[^{old}{old.lower()}]")
    turned = F.reverse(F.translate(seq, old + old.lower(), new + new))
    return F.when(bad, F.raise_error(F.concat(F.lit("no complement in "), seq))).otherwise(turned)


def allele_reverse_complement(allele: Column, alphabet: Alphabet = DNA) -> Column:
    """``*``, ``-`` and the empty allele become ``*``."""
    return F.when(allele.isin("*", "-", ""), F.lit("*")).otherwise(reverse_complement(allele, alphabet))


def reverse_complement_encoding(encoding: Column, alphabet: Alphabet = DNA) -> Column:
    """Columns permuted by complement, rows in reverse."""
    order = [alphabet.symbols.index(alphabet.complements[b]) for b in alphabet.symbols]
    return F.reverse(F.transform(encoding, lambda row: F.array(*[row[i] for i in order])))


def pad(seq: Column, length: int, alphabet: Alphabet = DNA) -> Column:
    """Unknown symbols on both sides, the odd one on the right; upper case."""
    gap = F.greatest(F.lit(length) - F.length(seq), F.lit(0))
    left = (gap / 2).cast("int")
    unknown = F.lit(alphabet.unknown)
    return F.upper(F.concat(F.repeat(unknown, left), seq, F.repeat(unknown, gap - left)))


def truncate(seq: Column, length: int) -> Column:
    """The centre of the sequence; upper case."""
    return F.upper(F.substring(seq, ((F.length(seq) - length) / 2).cast("int") + 1, F.lit(length)))


def pad_or_truncate(seq: Column, length: int, alphabet: Alphabet = DNA) -> Column:
    """Case stays where the length fits already."""
    n = F.length(seq)
    return F.when(n < length, pad(seq, length, alphabet)).when(n > length, truncate(seq, length)).otherwise(seq)


def has_unknown(seq: Column, alphabet: Alphabet = DNA) -> Column:
    """Whether the upper-case unknown symbol occurs."""
    return F.contains(seq, F.lit(alphabet.unknown))


def ambiguous_share(seq: Column, alphabet: Alphabet = DNA) -> Column:
    """The share of symbols outside the alphabet; null for the empty sequence."""
    known = alphabet.symbols + (alphabet.symbols.lower() if alphabet.any_case else "")
    return 1 - F.length(F.regexp_replace(seq, f"[^{known}]", "")) / F.nullif(F.length(seq), F.lit(0))


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def pack_bits(bits: Column) -> Column:
    """Eight 0/1 numbers to a byte, the first one highest; the last byte is filled with zeros."""

    def packed(held):
        def byte(i):
            # By place: a slice would copy the whole array for each byte.
            value = F.lit(0)
            for k in range(8):
                value = value * 2 + F.coalesce(F.get(held, i * 8 + k).cast("int"), F.lit(0))
            return value

        starts = F.sequence(F.lit(0), F.greatest(((F.size(held) + 7) / 8).cast("int") - 1, F.lit(0)))
        return F.when(F.size(held) == 0, F.array().cast("array<int>")).otherwise(F.transform(starts, byte))

    return once(bits, packed)


def unpack_bits(packed: Column, length: Column | int) -> Column:
    """The first ``length`` bits of the bytes."""
    def bits(b):
        return F.array(*[F.shiftright(b, i).bitwiseAND(1) for i in range(7, -1, -1)])

    return F.slice(F.flatten(F.transform(packed, bits)), F.lit(1), F.lit(length) if isinstance(length, int) else length)


def unpack_sequence(packed: Column, length: int) -> Column:
    """Packed encodings (one byte array per alphabet symbol) to rows; rows of only ones become 1/N."""
    unpacked = F.transform(packed, lambda lane: unpack_bits(lane, length))
    rows = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.transform(unpacked, lambda lane: F.get(lane, i).cast("float")))
    even = lambda row: F.transform(row, lambda v: (v / F.size(row)).cast("float"))
    return F.transform(rows, lambda row: F.when(F.forall(row, lambda v: v == 1), even(row)).otherwise(row))


def center_crop(values: Column, use: int, shift: int = 0) -> Column:
    """``use`` items around the middle, moved by ``shift``."""
    return once(values, lambda held: F.slice(held, (F.size(held) / 2).cast("int") - (use + 1) // 2 + shift + 1, F.lit(use)))


def multi_hot(indices: Column, number: int) -> Column:
    """A ``;``-joined list of positions to 0/1 numbers."""
    listed = F.transform(F.filter(F.split(indices, ";"), lambda x: x != ""), lambda x: x.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.array_contains(listed, i).cast("int"))


def positives(labels: Column) -> Column:
    """The positions of nonzero labels, ``;``-joined."""
    at = F.filter(F.transform(labels, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.array_join(F.transform(at, lambda i: i.cast("string")), ";")


def ensemble(*predictions: Column) -> Column:
    """The outputs of several models side by side."""
    return F.concat(*predictions)


def symbol_at(seq: Column, position: Column) -> Column:
    """The character at a position from 0."""
    return F.substring(seq, position + 1, F.lit(1))


def chunks(seq: Column, size: int) -> Column:
    """The sequence cut into pieces of ``size`` letters; the last one may be shorter, the empty sequence has none."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def clear_candidates(df, seq: str, most: float = 0.30):
    """P10: the rows whose sequence has no larger share of unknown letters than ``most``."""
    return df.filter(ambiguous_share(F.col(seq)) <= most)
