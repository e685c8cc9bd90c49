"""Where the chunks of a cleaned text stand in the text it was cleaned from."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the first and last piece that are looked for alone; likeness, of 100, from which a changed stretch is still the chunk's.
ANCHOR, LEAST_LIKE = 32, 80
_SEED, _BAND = 8, 32
#: Votes that are held at a time, about.
_VOTES = 1_000_000


#: White space, as str.split takes it.
_BLANK = np.array([c for c in range(0x110000) if chr(c).isspace()], "<u4")


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def places(a: str) -> dict[str, int]:
    """Where each letter stands in ``a``, as the bits of a number."""
    at: dict[str, int] = defaultdict(int)
    for k, letter in enumerate(a):
        at[letter] |= 1 << k
    return at


def common(a: str, b: str, at: dict[str, int] | None = None, needed: int = 0) -> int:
    """Length of the longest common subsequence, all of ``a`` at a time as the bits of a number; once it can't reach ``needed`` any more, a bound on it below that."""
    at = places(a) if at is None else at
    every = (1 << len(a)) - 1
    left, known, none = every, at.get, repeat(0)
    for begin in range(0, len(b), 64):
        for met in map(known, b[begin : begin + 64], none):
            met &= left
            if met:
                left = (left + met) | (left ^ met)  # what is carried over the end changes nothing below
        left &= every
        most = len(a) - left.bit_count() + max(0, len(b) - begin - 64)
        if most < needed:
            return most
    return len(a) - left.bit_count()


def _ranks(codes: np.ndarray, levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each piece of ``_SEED`` characters, equal for equal pieces, by doubling their length; -1 for those that ``levels`` of another text don't have."""
    known, made = levels is not None, levels or []
    now, width, level = codes.astype(np.int64), 1, 0
    while True:
        if not known:
            made.append(np.unique(now))
        own = made[level]
        at = np.minimum(np.searchsorted(own, now), max(0, len(own) - 1))
        now = np.where(own[at] == now, at, -1) if len(own) else np.full(len(now), -1)
        if width == _SEED:
            return now, made
        first, then = now[:-width], now[width:]
        now = np.where((first < 0) | (then < 0), -1, first * len(own) + then)
        width, level = 2 * width, level + 1


class Original:
    """A text with its white space collapsed, and the way back."""

    def __init__(self, text: str):
        self.text = text
        blank = np.isin(_letters(text), _BLANK)
        # of the white space after a word that isn't the last one the first character stands for all
        stays = ~blank
        stays[1:] |= ~blank[:-1]
        stays[np.flatnonzero(~blank)[-1] + 1 if not blank.all() else 0 :] = False
        self.flat = " ".join(text.split())
        self.places = np.flatnonzero(stays)
        self._seeds: tuple[list[np.ndarray], np.ndarray, np.ndarray] | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Places in the text of a stretch of the collapsed one, white space and what else lies in it included."""
        return int(self.places[start]), int(self.places[end - 1]) + 1

    def find(self, part: str, start: int) -> int:
        """From ``start`` on if it is there, else anywhere."""
        k = self.flat.find(part, start)
        return k if k >= 0 else self.flat.find(part)

    def anchored(self, part: str, start: int) -> tuple[int, int] | None:
        """From the first piece of ``part`` to its last one, which stand no closer than in it."""
        if len(part) < ANCHOR:
            return None
        for begin in (start, 0):
            head = self.flat.find(part[:ANCHOR], begin)
            tail = self.flat.find(part[-ANCHOR:], head + len(part) - ANCHOR) if head >= 0 else -1
            if tail >= 0:
                return head, tail + ANCHOR
        return None

    def like(self, part: str, start: int) -> tuple[int, int] | None:
        """The stretch as long as ``part`` that is most like it, if by ``LEAST_LIKE`` or more; of equal ones the first from ``start`` on.

        Common pieces of ``_SEED`` characters vote for where it begins, in bands that overlap; the bands with most votes are compared.
        """
        n = len(part)
        if n < _SEED or n > len(self.flat):
            return None
        if self._seeds is None:
            ranks, levels = _ranks(_letters(self.flat))
            order = np.argsort(ranks, kind="stable")
            self._seeds = (levels, order, ranks[order])
        levels, order, ranks = self._seeds
        asked = _ranks(_letters(part), levels)[0]
        first = np.searchsorted(ranks, asked)
        many = np.where(asked < 0, 0, np.searchsorted(ranks, asked, "right") - first)
        votes = np.zeros((len(self.flat) + n) // _BAND + 4, np.int64)
        ahead = n // _BAND + 1  # bands begin that far before the text
        cuts = np.searchsorted(np.cumsum(many), np.arange(_VOTES, many.sum() + _VOTES, _VOTES))
        for low, high in zip([0, *(cuts[:-1] + 1)], [*(cuts[:-1] + 1), len(many)], strict=True):
            own = many[low:high]
            each = np.repeat(np.arange(low, high), own)
            at = order[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + first[each]]
            band = (at - each) // _BAND + ahead
            votes += np.bincount(band, minlength=len(votes)) + np.bincount(band + 1, minlength=len(votes))
        best, least, seen = None, -(-LEAST_LIKE * n // 100), {}
        at = places(part)
        found = np.flatnonzero(votes)
        for band in (found[np.lexsort((found, -votes[found]))][:8] - ahead).tolist():
            begins = [min(max(0, b), len(self.flat) - n) for b in range((band - 1) * _BAND, (band + 1) * _BAND, _BAND // 4)]
            # windows lie in the stretch from the first to the last of them, which is at least as like
            if best is not None and common(part, self.flat[begins[0] : begins[-1] + n], at, least) < least:
                continue
            for begin in begins:
                # a window moved by one character gains or loses one at most
                if begin in seen or any(score + abs(begin - b) < least for b, score in seen.items()):
                    continue
                score = seen[begin] = common(part, self.flat[begin : begin + n], at, least)
                key = (score, begin >= start, -begin)
                if score >= least and (best is None or key > best[0]):
                    best, least = (key, begin), score
        return (best[1], best[1] + n) if best else None


def aligned(text: str | None, chunks: list[str | None]) -> list[tuple[int | None, int | None, str, str]]:
    """(start, end, method, step) of each chunk in ``text``, in the order of chunks.

    As it stands: exact. With white space made alike, between its first and last piece, or as the stretch most like it: fuzzy. Otherwise none. Each is looked for behind the
    start of the one before it first, then anywhere.
    """
    out: list[tuple[int | None, int | None, str, str]] = []
    text = text or ""
    at, original = -1, None
    for chunk in chunks:
        found = None
        if chunk:
            k = text.find(chunk, at + 1)
            k = k if k >= 0 else text.find(chunk)
            if k >= 0:
                found = (k, k + len(chunk), "exact", "exact")
            part = " ".join(chunk.split())
            if found is None and part:
                original = original or Original(text)
                start = int(np.searchsorted(original.places, at + 1))
                k = original.find(part, start)
                if k >= 0:
                    found = (*original.span(k, k + len(part)), "fuzzy", "spaces")
                elif (stretch := original.anchored(part, start)) is not None:
                    found = (*original.span(*stretch), "fuzzy", "anchors")
                elif (stretch := original.like(part, start)) is not None:
                    found = (*original.span(*stretch), "fuzzy", "window")
        out.append(found or (None, None, "none", "none"))
        if found:
            at = found[0]
    return out


def chunk_offsets(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, method, step): places in ``docs`` (doc_id, text) of ``chunks`` (doc_id, chunk_index, content).

    A document's chunks, as much text as it has itself, meet it in one row. Null and empty chunks and those of unknown documents are found nowhere.
    """
    own = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    rows = own.join(docs.select("doc_id", "text"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, own, text = (batch.column(c)[k].as_py() for c in ("doc_id", "chunks", "text"))
                found = aligned(text, [c["content"] for c in own])
                columns = [[doc] * len(own), [c["chunk_index"] for c in own], *map(list, zip(*found, strict=True))]
                kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "chunk_index", "char_start", "char_end", "method", "step"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "chunks", "text").mapInArrow(run, f"doc_id {kind}, chunk_index int, char_start bigint, char_end bigint, method string, step string")
