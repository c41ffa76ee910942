"""Changed sequences as runs, not bases.

A sequence with variants is a short list of runs: stretches of the reference, and texts that variants put in
their place or between them, with the offset of each. Slicing and lifting a position are
binary searches, and letters are fetched for what is asked for only, so the work follows the
number of variants and not of bases.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

Fetch = Callable[[int, int], str]


@dataclass(frozen=True)
class Edit:
    """A change of the reference: ref is what alt stands in place of."""

    start: int
    ref: str
    alt: str

    @property
    def end(self) -> int:
        return self.start + len(self.ref)


def split_variant(start: int, ref: str, alt: str) -> list[Edit]:
    """The common prefix goes; what is left is a substitution, an insertion or a deletion, or a substitution and one of these."""
    pad = 0
    while pad < min(len(ref), len(alt)) and ref[pad] == alt[pad]:
        pad += 1
    ref, alt, start = ref[pad:], alt[pad:], start + pad
    n = min(len(ref), len(alt))
    return [e for e in (Edit(start, ref[:n], alt[:n]), Edit(start + n, ref[n:], alt[n:])) if e.ref or e.alt]


def clipped(edit: Edit, low: int, high: int) -> Edit | None:
    """The part of an edit within [low, high]; alleles are cut alike."""
    if edit.end < low or edit.start > high:
        return None
    head, tail = max(0, low - edit.start), max(0, edit.end - high)
    ref, alt = edit.ref[head:], edit.alt[head:]
    if tail:
        ref, alt = ref[: max(0, len(ref) - tail)], alt[: max(0, len(alt) - tail)]
    return Edit(max(edit.start, low), ref, alt) if ref or alt else None


class Pieces:
    """Runs in order: where each begins in the changed sequence, its first reference position, its text (None: the reference's) and,
    of inserted text, the place of its first letter within the insertion (else -1)."""

    def __init__(self) -> None:
        self.at, self.start, self.text, self.place = [0], [], [], []

    def __len__(self) -> int:
        return self.at[-1]

    def _add(self, n: int, start: int, text: str | None, place: int) -> None:
        if n > 0:
            self.at.append(self.at[-1] + n)
            self.start.append(start)
            self.text.append(text)
            self.place.append(place)

    def reference(self, start: int, end: int) -> None:
        self._add(end - start, start, None, -1)

    def edit(self, e: Edit) -> None:
        """What an edit puts in: letters in place of the reference's, then those that are more, before the base that follows."""
        n = min(len(e.ref), len(e.alt))
        self._add(n, e.start, e.alt[:n], -1)
        self._add(len(e.alt) - n, e.end, e.alt[n:], 0)

    def extend(self, other: Pieces) -> None:
        for i, (s, t, p) in enumerate(zip(other.start, other.text, other.place, strict=True)):
            self._add(other.at[i + 1] - other.at[i], s, t, p)

    def sliced(self, low: int, high: int) -> Pieces:
        """The runs of [low, high), as of a text."""
        low, high = max(0, low), min(high, len(self))
        out = Pieces()
        i = bisect_right(self.at, low) - 1
        while i < len(self.start) and self.at[i] < high:
            a, b = max(low, self.at[i]) - self.at[i], min(high, self.at[i + 1]) - self.at[i]
            text, place = self.text[i], self.place[i]
            out._add(b - a, self.start[i] + (a if place < 0 else 0), None if text is None else text[a:b], place if place < 0 else place + a)
            i += 1
        return out

    def lift(self, k: int) -> tuple[int, int]:
        """The reference position of base k, and its place within an insertion, or -1."""
        i = bisect_right(self.at, k) - 1
        more = k - self.at[i]
        return (self.start[i] + more, -1) if self.place[i] < 0 else (self.start[i], self.place[i] + more)

    def letters(self, fetch: Fetch) -> str:
        n = (b - a for a, b in zip(self.at, self.at[1:], strict=False))
        return "".join(fetch(s, s + k) if t is None else t for s, t, k in zip(self.start, self.text, n, strict=True))


def _between(start: int, end: int, edits: list[Edit]) -> Pieces:
    """A window with edits that lie within it, in order of their starts."""
    out, at = Pieces(), start
    for e in edits:
        if e.start < at:
            raise ValueError("variants overlap")
        out.reference(at, e.start)
        out.edit(e)
        at = e.end
    out.reference(at, end)
    return out


def _before(anchor: int, n: int, edits: list[Edit]) -> Pieces:
    """The last n bases before the anchor, of edits that end there at most: a walk outward that stops when there are enough."""
    have, at, near = 0, anchor, []
    for e in reversed(edits):
        if e.end > at:
            raise ValueError("variants overlap")
        if have + at - e.end >= n:
            break
        have, at = have + at - e.end + len(e.alt), e.start
        near.append(e)
        if have >= n:
            break
    whole = _between(at - max(0, n - have), anchor, near[::-1])
    return whole.sliced(len(whole) - n, len(whole))


def _after(anchor: int, n: int, edits: list[Edit]) -> Pieces:
    """The first n bases after the anchor."""
    have, at, near = 0, anchor, []
    for e in edits:
        if e.start < at:
            raise ValueError("variants overlap")
        if have + e.start - at >= n:
            break
        have, at = have + e.start - at + len(e.alt), e.end
        near.append(e)
        if have >= n:
            break
    return _between(anchor, at + max(0, n - have), near).sliced(0, n)


def apply_variants(start: int, end: int, variants: list[tuple[int, str, str]], anchor: int | None = None, anchor_offset: int = 0) -> Pieces:
    """A plus-strand window with variants (start, ref, alt) applied.

    Without an anchor the window's edges hold and its
    length may change. With one the length holds: the sequence left of the anchor is the end of
    the changed sequence up to it, the one right of it the beginning of what follows, so that
    deletions draw bases in and insertions push bases out. An insertion at the anchor gives its
    first anchor_offset bases to the left.
    """
    edits = sorted((e for v in variants for e in split_variant(*v)), key=lambda e: e.start)
    if anchor is None:
        return _between(start, end, [c for e in edits if (c := clipped(e, start, end))])
    left, right = [], []
    for e in edits:
        if e.start == anchor and not e.ref:
            left.append(Edit(anchor, "", e.alt[:anchor_offset]))
            right.append(Edit(anchor, "", e.alt[anchor_offset:]))
        else:
            left += [c] if (c := clipped(e, -(1 << 60), anchor)) else []
            right += [c] if (c := clipped(e, anchor, 1 << 60)) else []
    out = _before(anchor, anchor - min(start, anchor), left)
    out.extend(_after(anchor, max(end, anchor) - anchor, right))
    if anchor > end:
        return out.sliced(0, end - start)
    if anchor < start:
        return out.sliced(len(out) - (end - start), len(out))
    return out
