"""Sequence ranges and read actions: parameters of refining and tagging, checked when they are made.

Positions are 1-based and inclusive. ``seq_range(3, 5)`` spans bases 3 to 5, ``seq_range(start=3)`` goes from base 3 to
the end, ``seq_range(end=5)`` from the first base to the 5th.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeqRange:
    """Bases ``first`` (from 0) up to, without, ``stop``; None for the sequence's end."""

    first: int
    stop: int | None
    #: "to" if only an end was given, "from" if only a start, else "span".
    kind: str

    def __add__(self, other: SeqRange | Iterable[SeqRange]) -> list[SeqRange]:
        return [self, *as_ranges(other)]

    def __repr__(self) -> str:
        return {"to": f"..{self.stop}", "from": f"{self.first + 1}.."}.get(self.kind, f"{self.first + 1}..{self.stop}")

    @property
    def order(self) -> tuple[int, int, int]:
        """Ranges to an end come first, then spans, then ranges from a start; each by bounds."""
        return ({"to": 0, "span": 1, "from": 2}[self.kind], self.first, self.stop or 0)


def seq_range(start: int | None = None, end: int | None = None) -> SeqRange:
    for x, name in ((start, "start"), (end, "end")):
        if x is not None and (not isinstance(x, int) or isinstance(x, bool) or x < 1):
            raise ValueError(f"{name} must be an integer from 1")
    if start is None and end is None:
        raise ValueError("a range needs a start or an end")
    if start is None:
        return SeqRange(0, end, "to")
    if end is None:
        return SeqRange(start - 1, None, "from")
    if start > end:
        raise ValueError(f"the start {start} lies after the end {end}")
    return SeqRange(start - 1, end, "span")


def as_ranges(x: SeqRange | Iterable[SeqRange]) -> list[SeqRange]:
    ranges = [x] if isinstance(x, SeqRange) else list(x)
    if not ranges or not all(isinstance(r, SeqRange) for r in ranges):
        raise ValueError("one or more ranges are needed")
    return ranges


def without_overlap(x: SeqRange | Iterable[SeqRange]) -> list[SeqRange]:
    """The ranges in order; they may touch but not overlap, and at most one may be open at each side."""
    ranges = sorted(as_ranges(x), key=lambda r: r.order)
    for kind in ("to", "from"):
        if sum(r.kind == kind for r in ranges) > 1:
            raise ValueError(f"more than one range has only {'an end' if kind == 'to' else 'a start'}")
    for a, b in zip(ranges, ranges[1:]):
        if a.stop is None or b.first < a.stop:
            raise ValueError(f"ranges {a!r} and {b!r} overlap")
    return ranges


def merged(ranges: Iterable[SeqRange]) -> list[tuple[int, int | None]]:
    """Bounds of the union of ranges, in order."""
    out: list[list[int | None]] = []
    for first, stop in sorted(((r.first, r.stop) for r in ranges), key=lambda x: x[0]):
        if out and (out[-1][1] is None or first <= out[-1][1]):
            if out[-1][1] is not None:
                out[-1][1] = None if stop is None else max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


@dataclass(frozen=True)
class Tag:
    """Bases of ``ranges``, put together in order, under a label."""

    label: str
    ranges: tuple[SeqRange, ...]


@dataclass(frozen=True)
class Embed(Tag):
    """A tag that goes into the read's description."""


@dataclass(frozen=True)
class EmbedTrim(Tag):
    """A tag that goes into the description and is cut out of the read."""


@dataclass(frozen=True)
class Trim:
    """Ranges that are cut out of the read."""

    ranges: tuple[SeqRange, ...]


Action = Embed | EmbedTrim | Trim


def _label(label: str) -> str:
    if not isinstance(label, str) or not label or any(c in label for c in ":{}") or any(c.isspace() for c in label):
        raise ValueError("a label must be a text without white space, ':' and braces")
    return label


def tag(label: str, ranges: SeqRange | Iterable[SeqRange]) -> Tag:
    return Tag(_label(label), tuple(without_overlap(ranges)))


def embed(label: str, ranges: SeqRange | Iterable[SeqRange]) -> Embed:
    return Embed(_label(label), tuple(without_overlap(ranges)))


def embed_trim(label: str, ranges: SeqRange | Iterable[SeqRange]) -> EmbedTrim:
    return EmbedTrim(_label(label), tuple(without_overlap(ranges)))


def trim(ranges: SeqRange | Iterable[SeqRange]) -> Trim:
    return Trim(tuple(as_ranges(ranges)))


def action_for(x: Action | SeqRange | list[SeqRange] | None, label: str) -> list[Action]:
    """The action given for a UMI or barcode; bare ranges are embedded under ``label`` and trimmed."""
    if x is None:
        return []
    if isinstance(x, (Embed, EmbedTrim, Trim)):
        return [x]
    return [embed_trim(label, x)]


def extra_actions(x: object) -> list[Action]:
    """Further actions: actions as they are, bare ranges trimmed; one or a list of them."""
    if x is None:
        return []
    if isinstance(x, (Embed, EmbedTrim, Trim)):
        return [x]
    if isinstance(x, SeqRange):
        return [trim(x)]
    return [a for one in x for a in extra_actions(one)]


def tags_for(x: dict[str, SeqRange | list[SeqRange]] | Iterable[Tag] | Tag | None) -> list[Tag]:
    """Tags from tags, or from labels with bare ranges; ranges without a label are refused."""
    if x is None:
        return []
    if isinstance(x, Tag):
        return [x]
    if isinstance(x, dict):
        return [r if isinstance(r, Tag) else tag(name, r) for name, r in x.items()]
    tags = list(x)
    if not all(isinstance(t, Tag) for t in tags):
        raise ValueError("a range needs a label: tag(label, ranges)")
    return tags


def checked(seq: Column, r: SeqRange) -> Column:
    """The bases of a range; an error where the sequence doesn't reach it."""
    n = F.length(seq)
    short = n < r.stop if r.stop is not None else n <= r.first
    message = F.concat(F.lit(f"range {r!r} is out of bounds of a sequence of length "), n.cast("string"))
    part = F.substring(seq, r.first + 1, 2**31 - 1 if r.stop is None else r.stop - r.first)
    return F.when(short, F.raise_error(message)).otherwise(part)


def extracted(seq: Column, ranges: Iterable[SeqRange]) -> Column:
    """Bases of all ranges together, in order."""
    return F.concat(*[checked(seq, r) for r in ranges])


def remaining(text: Column, ranges: Iterable[SeqRange]) -> Column:
    """What is left of ``text`` without the union of ranges."""
    parts, at = [], 0
    for first, stop in merged(ranges):
        if first > at:
            parts.append(F.substring(text, at + 1, first - at))
        if stop is None:
            break
        at = stop
    else:
        parts.append(F.substring(text, at + 1, 2**31 - 1))
    return F.concat(*parts) if parts else F.lit("")
