"""Suffix-array deduplication by a depth-limited radix sort.

A suffix is ordered only through its first ``length`` bytes, and only as far
as it takes to tell which suffixes share all of them.  The sort goes by
most-significant digits; after each pass the suffixes that stand alone are
done and move no further:

0. *Sections.*  Runs of suffixes are first taken together in sections of about
   thirty anchors, cut where the content says so.  A section that occurred before
   as a whole loses all of its windows there and then, and its suffixes need
   no order; only each section's first occurrence goes on.  Whole copies end
   here, at the price of one row for some 1,000 bytes.
1. *Anchor digit.*  Of the 32-byte strings inside a suffix's first ``length``
   bytes the one with the least hash is its anchor.  Equal windows have equal
   anchors at equal places, so the anchor is a digit that any two equal
   suffixes share; neighbouring suffixes mostly have one anchor, so one row
   stands for a run of them.  Tasks pre-aggregate anchors into sorted packed
   arrays per hash range; a range's task finds those met twice and sets their
   bits in a filter of fixed size.
2. *Run digit.*  Runs whose anchor's bit is set are dealt out by anchor with a
   digest of the bytes they span, after each task has settled those that are
   equal among its own.  Of equal runs all but the earliest lose all of their
   windows; an anchor with one digest left is done.
3. *Offset and content digits.*  The runs that are left, one of each kind, are
   dealt out by anchor with their bytes.  Within an anchor, suffixes are
   ordered by the anchor's offset and their content, and each group's members
   are compared byte by byte with its earliest one.

Anchors that very many runs share never meet in one task: pass 1 counts runs
for each anchor, and those with more than ``hot`` go through the same digits as
aggregates and joins, which combine before they shuffle and can be split.  There
the last digit is a 128-bit hash of the window in place of its bytes.

Groups of equal digits at the end are exactly the repeated windows; all but
the earliest of a group lose their bytes.  The filter only saves work: a bit
set by chance adds a row that ends alone.  Anchors with more than ``hot`` kinds
of runs never meet in one task: equal runs are first reduced to their earliest
by an aggregate that combines before it shuffles, and the windows of the runs
that stay are grouped by hash as rows of their own.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; rows that share a doc_id are told apart and ordered by
their text's 128-bit digest, and rows equal in doc_id and text count as one
place and get equal results; a null doc_id is below all others; an empty table
gives an empty table; other columns pass through, and ``n_bytes``,
``n_removed``, ``n_spans`` and ``kept`` replace columns of that name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.llm.common import materialise, tune
from linkmap.llm.key_filter import has, key_filter

GRAM = 32
#: Texts are hashed in pieces of so many bytes.
PIECE = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
#: Bits of the filter of repeated anchors, 16 MB: a bound that doesn't grow with the data.
FILTER_BITS = 27
#: Runs from which on an anchor is dealt out by its digits in place of whole; at most 65,535, where counts end.
HOT = 50_000
#: Different runs that a task holds to find equal ones among its own.
HELD = 150_000
#: Windows that are compared at a time within one anchor.
WINDOWS = 1 << 20
#: Bits of the filter of sections' first occurrences, 8 MB.
FIRST_BITS = 26
#: An anchor begins a section if its hash is a multiple of this.
SECTION = np.uint64(32)
#: Bytes of runs that a task compares at a time, beside the rest of one anchor.
BUFFER = 1 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _eights(buf: bytes) -> np.ndarray:
    """A hash of the eight bytes at each place."""
    return _mix(np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)).astype(np.uint64) + _M3)


class Runs:
    """Runs of windows with one anchor: lo to hi are starts in buf, at is the anchor's place, span the piece, key the anchor's hash."""

    def __init__(self, buf: bytes, spans: list[tuple[int, int]], length: int):
        e = _eights(buf)
        g = e
        for k in range(8, GRAM, 8):
            g = g[: len(e) - k] * _M3 + e[k:]
        g = _mix(g)
        width = length - GRAM + 1
        least = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: -(width - have)], least[width - have :])
        starts = np.concatenate([np.arange(o, o + n - length + 1) for o, n in spans])
        at = (least[starts] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.lo, self.hi, self.at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
        self.key = g[self.at]
        self.span = np.searchsorted([o for o, _ in spans], self.lo, "right") - 1


def runs_of(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, Runs]]:
    """Pieces of texts as (bytes, each span's text, each span's offset less its place in the piece, runs)."""
    held: list[bytes] = []
    spans: list[tuple[int, int]] = []
    which: list[int] = []
    shift: list[int] = []
    size = 0

    def piece():
        buf = b"".join(held)
        return buf, np.array(which), np.array(shift), Runs(buf, spans, length)

    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[a : a + PIECE + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > PIECE:
                yield piece()
                held, spans, which, shift, size = [], [], [], [], 0
            held.append(part)
            spans.append((size, len(part)))
            which.append(k)
            shift.append(a - size)
            size += len(part)
    if size:
        yield piece()


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in _column(b, "__text").cast(pa.binary()).to_pylist()]


def _tag_words(tags: pa.Array) -> np.ndarray:
    """The first eight bytes of each text's digest, for filters."""
    return np.frombuffer(b"".join(tags.to_pylist()), "<u8")[::2]


def _place_keys(ids: np.ndarray, tags: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of a place for filters, which never decide a result: id (0 if null), the text's digest, the offset."""
    return _mix(_mix(ids.astype(np.int64).view(np.uint64) * _M3 + tags) + lo.astype(np.int64).view(np.uint64)).view(np.int64)


def _places(b: pa.RecordBatch) -> np.ndarray:
    return _place_keys(np.array(_column(b, "__id").fill_null(0)), _tag_words(_column(b, "__tag")), np.array(_column(b, "lo")))


def _sections(r: Runs) -> np.ndarray:
    """The first run of each section."""
    return np.flatnonzero((r.key % SECTION == 0) | np.concatenate([[True], r.span[1:] != r.span[:-1]]))


def _first_runs(b: pa.RecordBatch, length: int, firsts: np.ndarray) -> Iterator[tuple]:
    """Pieces of a batch's texts, and the runs in them that lie in the first occurrence of their section."""
    ids, tags = np.array(_column(b, "__id").fill_null(0)), _tag_words(_column(b, "__tag"))
    for buf, which, shift, r in runs_of(_texts(b), length):
        begin = _sections(r)
        doc = which[r.span[begin]]
        first = has(firsts, _place_keys(ids[doc], tags[doc], r.lo[begin] + shift[r.span[begin]]), FIRST_BITS)
        yield buf, which, shift, r, np.flatnonzero(np.repeat(first, np.diff(np.append(begin, len(r.lo)))))


SECTIONS = "h long, g long, __id long, __tag binary, lo long, n long"


def section_rows(rows: DataFrame, length: int) -> DataFrame:
    """Each section's digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = _column(b, "__id"), _column(b, "__tag")
            for buf, which, shift, r in runs_of(_texts(b), length):
                begin = _sections(r)
                lo, end = r.lo[begin], r.hi[np.append(begin[1:], len(r.lo)) - 1] + length
                digests = np.frombuffer(b"".join([hashlib.blake2b(buf[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                doc = pa.array(which[r.span[begin]])
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), ids.take(doc), tags.take(doc), pa.array(lo + shift[r.span[begin]]), pa.array(end - lo)], names=["h", "g", "__id", "__tag", "lo", "n"])

    return rows.mapInArrow(run, SECTIONS)


def repeated_filter(rows: DataFrame, length: int, firsts, bits: int = FILTER_BITS, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Bit filters over the leading bits of the hashes of anchors: those met twice or more, and those met more than ``hot`` times."""
    spark = rows.sparkSession
    n_ranges = 1 << min(bits - 3, max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    down = np.uint64(64 - int(math.log2(n_ranges)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(key >> down, np.arange(n_ranges + 1, dtype=np.uint64))
            n = np.minimum(n, 0xFFFF).astype("<u2")
            some = [r for r in range(n_ranges) if cut[r] < cut[r + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([key[cut[r] : cut[r + 1]].astype("<u8").tobytes() for r in some], pa.binary()), pa.array([n[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())], names=["range", "keys", "counts"]
            )

        for b in batches:
            for *_, r, k in _first_runs(b, length, firsts.value):
                if not len(k):
                    continue
                held.append(r.key[k])
                size += len(k)
                if size >= 1 << 21:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    slots = (1 << bits) // n_ranges

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["keys"]])
        n = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n, first)
        slot = (keys[first] >> np.uint64(64 - bits)) & np.uint64(slots - 1)
        marks = []
        for least in (1, hot):
            mark = np.zeros(slots, np.uint8)
            mark[slot[n > least]] = 1
            marks.append(np.packbits(mark).tobytes())
        return pd.DataFrame({"range": [key[0]], "twice": [marks[0]], "often": [marks[1] if any(marks[1]) else None]})

    parts = rows.mapInArrow(pack, "range int, keys binary, counts binary").groupBy("range").applyInPandas(meet, "range int, twice binary, often binary")
    found, often = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)
    n = slots // 8
    for r, x, y in parts.collect():  # at most twice 2**bits bits in all, however large the input
        found[r * n : (r + 1) * n] = np.frombuffer(bytes(x), np.uint8)
        if y is not None:
            often[r * n : (r + 1) * n] = np.frombuffer(bytes(y), np.uint8)
    return found, often


def _has(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    slot = key >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


DIGEST = "anchor long, off int, h long, g long, __id long, __tag binary, lo long, end long"
RUN = "anchor long, __id long, __tag binary, lo long, off int, body binary"


class _Own:
    """Runs that a task has met, by digest: of equal ones the earliest is dealt out, the others lose their windows at once."""

    def __init__(self):
        self.first: dict[tuple, tuple] = {}
        self.lost: list[tuple] = []

    def add(self, keys: list[tuple], places: list[tuple]) -> None:
        first, lost = self.first, self.lost
        for key, place in zip(keys, places, strict=True):
            have = first.setdefault(key, place)
            if have is not place:
                if place == have:
                    continue
                if place < have:
                    first[key], place = place, have
                lost.append(place)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What is held: lost stretches of one text that touch are one row, of anchor 0 and no digest."""
        if self.first:
            keys = sorted(self.first)
            yield self._batch([(k[0], k[1], *np.frombuffer(k[2], "<i8").tolist()) for k in keys], [self.first[k] for k in keys])
        joined: list[list] = []
        for x in sorted(self.lost):
            if joined and joined[-1][:3] == list(x[:3]) and x[3] <= joined[-1][4]:
                joined[-1][4] = max(joined[-1][4], x[4])
            else:
                joined.append(list(x))
        if joined:
            yield self._batch([(x[3] & 0xFF, 0, None, None) for x in joined], joined)
        self.first, self.lost = {}, []

    @staticmethod
    def _batch(keys: list[tuple], places: list) -> pa.RecordBatch:
        anchors, offs, h, g = zip(*keys, strict=True)
        known, ids, tags, lo, end = zip(*places, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors, pa.int64()), pa.array(offs, pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array([i if k else None for k, i in zip(known, ids, strict=True)], pa.int64()), pa.array(tags, pa.binary()), pa.array(lo, pa.int64()), pa.array(end, pa.int64())],
            names=["anchor", "off", "h", "g", "__id", "__tag", "lo", "end"],
        )


def _digests(rows: DataFrame, length: int, marked, firsts, bits: int) -> DataFrame:
    """Runs whose anchor's bit is set: the anchor, its offset, a digest of the run's bytes, the place; rows without a digest are stretches that are lost already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Own()
        for b in batches:
            known = [x is not None for x in _column(b, "__id").to_pylist()]
            ids, tags = _column(b, "__id").fill_null(0).to_pylist(), _column(b, "__tag").to_pylist()
            for buf, which, shift, r, k in _first_runs(b, length, firsts.value):
                k = k[_has(marked.value, r.key[k], bits)]
                if not len(k):
                    continue
                doc, lo, hi = which[r.span[k]].tolist(), r.lo[k], r.hi[k] + length
                digest = [hashlib.blake2b(buf[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                move = shift[r.span[k]]
                places = [(known[d], ids[d], tags[d], x, y) for d, x, y in zip(doc, (lo + move).tolist(), (hi + move).tolist(), strict=True)]
                own.add(list(zip(r.key[k].view(np.int64).tolist(), (r.at[k] - lo).tolist(), digest, strict=True)), places)
                if len(own.first) > HELD or len(own.lost) > 4 * HELD:
                    yield from own.batches()
        yield from own.batches()

    return rows.mapInArrow(run, DIGEST)


def _again(t: pa.Table) -> np.ndarray:
    """Which rows are at the place of the row before them: rows that are equal in id and text."""
    if t.num_rows < 2:
        return np.zeros(t.num_rows, bool)
    same = np.ones(t.num_rows - 1, bool)
    for name in ("__id", "__tag", "lo"):
        c = t.column(name).combine_chunks()
        one, two = c.slice(0, len(c) - 1), c.slice(1)
        same &= np.array(pc.or_kleene(pc.equal(one, two), pc.and_(one.is_null(), two.is_null())).fill_null(False))
    return np.concatenate([[False], same])


SETTLED = "__id long, __tag binary, a long, b long"


def _classes():
    """Rows sorted by anchor, digest and place: equal runs but the earliest are lost; where an anchor has several digests, the earliest of each needs its bytes compared.

    Gives lost stretches and the starts of runs whose bytes are needed (b is null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {n: t.column(n).combine_chunks() for n in t.column_names}
            settled = np.array(c["h"].is_null())
            key = np.stack([np.array(c[n].fill_null(0)).astype(np.int64) for n in ("anchor", "off", "h", "g")])
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
            first = np.concatenate([[True], key[0, 1:] != key[0, :-1]])
            start = np.flatnonzero(first)
            count = np.add.reduceat((new & ~settled).astype(np.int64), start)
            several = np.repeat(count, np.diff(np.append(start, len(first))))
            need = new & ~settled & (several > 1)
            # a group's first place may come from several equal rows; none of them is lost
            place = np.flatnonzero(~(again := _again(t) & ~new))
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            at_head = again & (place[np.searchsorted(place, np.arange(len(new)), "right") - 1] == head)
            for mask, is_lost in ((settled | ~new & ~at_head, True), (need, False)):
                if mask.any():
                    m = pa.array(mask)
                    part = {n: c[n].filter(m) for n in ("__id", "__tag", "lo", "end")}
                    yield pa.RecordBatch.from_arrays([part["__id"], part["__tag"], part["lo"], part["end"] if is_lost else pa.nulls(len(part["lo"]), pa.int64())], names=["__id", "__tag", "a", "b"])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < 8 * BUFFER:
                continue
            t = pa.Table.from_batches(held)
            anchor = np.array(t.column("anchor").combine_chunks())
            cut = int(np.argmax(anchor == anchor[-1]))
            if cut:
                yield from done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _bodies(rows: DataFrame, length: int, needed, marked, firsts, bits: int) -> DataFrame:
    """The bytes of the runs whose anchor's bit is set and whose place is in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = _column(b, "__id"), _column(b, "__tag")
            id0, tag0 = np.array(ids.fill_null(0)), _tag_words(tags)
            for buf, which, shift, r, k in _first_runs(b, length, firsts.value):
                k = k[_has(marked.value, r.key[k], bits)]
                doc, at = which[r.span[k]], r.lo[k] + shift[r.span[k]]
                hit = has(needed.value, _place_keys(id0[doc], tag0[doc], at), FIRST_BITS)
                k, doc, at = k[hit], pa.array(doc[hit]), at[hit]
                if len(k):
                    body = [buf[x:y] for x, y in zip(r.lo[k].tolist(), (r.hi[k] + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.key[k].view(np.int64)), ids.take(doc), tags.take(doc), pa.array(at), pa.array((r.at[k] - r.lo[k]).astype(np.int32)), pa.array(body, pa.binary())], names=["anchor", "__id", "__tag", "lo", "off", "body"])

    return rows.mapInArrow(run, RUN)


def _window_hash(buf: bytes, length: int) -> np.ndarray:
    """A hash of the length bytes at each place of buf."""
    h, have = _eights(buf), 8
    while 2 * have <= length:
        h = _mix(h[:-have] * _M3 + h[have:])
        have *= 2
    if have < length:
        h = _mix(h[: -(length - have)] * _M3 + h[length - have :])
    return h


def _windows(bodies: list[bytes], offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all windows of some runs: the run, the place in the joined bytes, the anchor's offset; and those bytes."""
    n = np.array([len(x) for x in bodies])
    begin, count = np.cumsum(n) - n, n - length + 1
    run = np.repeat(np.arange(len(bodies)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return run, begin[run] + step, offs[run] - step, b"".join(bodies)


def later_windows(anchor: np.ndarray, offs: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window's number in it) of all windows that an earlier run of the same anchor has at the same offset; runs come in order of place."""
    total = sum(map(len, bodies)) - (length - 1) * len(bodies)
    if total > WINDOWS and (anchor == anchor[0]).all() and len(np.unique(offs)) + max(map(len, bodies)) > 1:
        return _by_offset(offs, bodies, length)
    run, place, off, buf = _windows(bodies, offs, length)
    key = _mix(_window_hash(buf, length)[place] ^ _mix(anchor.view(np.uint64)[run] * _M3 + off.astype(np.uint64)))
    order = np.argsort(key)
    ordered = key[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(start, len(order)))
    first = np.repeat(np.minimum.reduceat(order, start), size)
    more = np.repeat(size > 1, size) & (order != first)
    later, first = order[more], first[more]
    # the last digit is the content itself: nothing rests on hashes alone
    whole = np.ndarray((len(buf) - length + 1,), f"V{length}", buf, 0, (1,))
    same = (anchor[run[later]] == anchor[run[first]]) & (off[later] == off[first])
    for a in range(0, len(later), 1 << 16):
        same[a : a + (1 << 16)] &= whole[place[later[a : a + (1 << 16)]]] == whole[place[first[a : a + (1 << 16)]]]
    if not same.all():  # keys that collided: tell those groups apart by content
        clash = np.isin(key, np.unique(key[later[~same]]))
        keep = ~clash[later]
        seen, extra = set(), []
        for i in np.flatnonzero(clash).tolist():
            full = (int(anchor[run[i]]), int(off[i]), buf[place[i] : place[i] + length])
            if full in seen:
                extra.append(i)
            seen.add(full)
        later = np.concatenate([later[keep], np.array(extra, np.int64)])
    later.sort()
    return run[later], place[later] - (np.cumsum([len(x) for x in bodies]) - np.array([len(x) for x in bodies]))[run[later]]


def _by_offset(offs: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for very many runs of one anchor: the windows of one offset at a time."""
    count = np.array([len(x) for x in bodies]) - length + 1
    runs, steps = [], []
    for off in range(int((offs - count).min()) + 1, int(offs.max()) + 1):
        step = offs - off
        seen: set[bytes] = set()
        for i in np.flatnonzero((step >= 0) & (step < count)).tolist():
            w = bodies[i][step[i] : step[i] + length]
            if w in seen:
                runs.append(i)
                steps.append(int(step[i]))
            seen.add(w)
    order = np.lexsort((steps, runs)) if runs else np.zeros(0, np.int64)
    return np.array(runs, np.int64)[order], np.array(steps, np.int64)[order]


LOST = "__id long, __tag binary, a long, b long"


def _lost(ids: pa.Array, tags: pa.Array, lo: np.ndarray, run: np.ndarray, step: np.ndarray, length: int) -> pa.RecordBatch:
    """Stretches of lost bytes from lost windows, which are sorted by run and step."""
    new = np.flatnonzero(np.concatenate([[len(run) > 0], (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1)]))
    end = (np.append(new[1:], len(run)) - 1)[: len(new)]
    r = run[new]
    at = pa.array(r, pa.int64())
    return pa.RecordBatch.from_arrays([ids.take(at), tags.take(at), pa.array(lo[r] + step[new]), pa.array(lo[r] + step[end] + length)], names=["__id", "__tag", "a", "b"])


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Which rows have another key than the row before them."""
    k = np.array(keys.combine_chunks())
    return np.concatenate([[True], k[1:] != k[:-1]])


def _compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and place; whole anchors are compared together."""
        held: list[pa.RecordBatch] = []
        size = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.filter(pa.array(~(_again(t) & ~_starts(t.column("anchor")))))
            c = {n: t.column(n).combine_chunks() for n in t.column_names}
            found = later_windows(np.array(c["anchor"]), np.array(c["off"]).astype(np.int64), c["body"].to_pylist(), length)
            return _lost(c["__id"], c["__tag"], np.array(c["lo"]), *found, length)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < BUFFER:
                continue
            t = pa.Table.from_batches(held)
            anchor = np.array(t.column("anchor").combine_chunks())
            cut = int(np.argmax(anchor == anchor[-1]))
            if cut:
                yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _hot_lost(runs: DataFrame, length: int) -> DataFrame:
    """Stretches lost by windows of runs of hot anchors, one run of each kind, as rows that spread over all tasks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {x: b.column(b.schema.get_field_index(x)) for x in b.schema.names}
            anchor, lo, offs, bodies = np.array(c["anchor"]), np.array(c["lo"]), np.array(c["off"]).astype(np.int64), c["body"].to_pylist()
            run, at, off, buf = _windows(bodies, offs, length)
            at_run = pa.array(run, pa.int64())
            begin = np.cumsum([len(x) for x in bodies]) - np.array([len(x) for x in bodies])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[run]), pa.array(off.astype(np.int32)), pa.array(_window_hash(buf, length)[at].view(np.int64)), pa.array(_window_hash(buf[::-1], length)[len(buf) - at - length].view(np.int64)),
                    c["__id"].take(at_run), c["__tag"].take(at_run), pa.array(lo[run] + at - begin[run]),
                ],
                names=["anchor", "off", "h", "g", "__id", "__tag", "s"],
            )

    windows = runs.mapInArrow(explode, "anchor long, off int, h long, g long, __id long, __tag binary, s long")
    key, at = ["anchor", "off", "h", "g"], F.struct("__id", "__tag", "s")
    # written, so that the join's hot keys can be split
    firsts = materialise(windows.groupBy(*key).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    return windows.join(firsts, key).where(~at.eqNullSafe(F.col("first"))).select("__id", "__tag", F.col("s").alias("a"), (F.col("s") + length).alias("b"))


def _hot_classes(digests: DataFrame) -> DataFrame:
    """What _classes gives, for anchors with very many runs, without bringing any anchor's rows together."""
    place = F.struct("__id", "__tag", "lo")
    key = ["anchor", "off", "h", "g"]
    told = digests.where("h is not null")
    kinds = materialise(told.groupBy(*key).agg(F.min(place).alias("first")), "hot-kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    copies = told.join(kinds, key).where(~place.eqNullSafe(F.col("first"))).select("__id", "__tag", F.col("lo").alias("a"), F.col("end").alias("b"))
    need = kinds.join(materialise(several, "several"), "anchor").select("first.__id", "first.__tag", F.col("first.lo").alias("a"), F.lit(None).cast("long").alias("b"))
    return digests.where("h is null").select("__id", "__tag", F.col("lo").alias("a"), F.col("end").alias("b")).unionByName(copies).unionByName(need)


def _joined(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, length: int = 100, hot: int = HOT, bits: int = FILTER_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and text without the removed spans, which are narrowed to whole characters there."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    spark = tune(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    tag = F.unhex(F.md5(text))
    rows = docs.select(F.col(id_column).cast("long").alias("__id"), tag.alias("__tag"), text.alias("__text"))
    sections = materialise(section_rows(rows, length), "sections")
    place = F.struct("__id", "__tag", "lo")
    kinds = materialise(sections.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "kinds")
    firsts = spark.sparkContext.broadcast(key_filter(kinds.select("first.*"), FIRST_BITS, _places))
    copied = sections.join(kinds.where("times > 1").drop("times"), ["h", "g"]).where(~place.eqNullSafe(F.col("first"))).select("__id", "__tag", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    twice, often = repeated_filter(rows, length, firsts, bits, hot)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("__id").asc_nulls_first(), F.col("__tag"), F.col("lo")
    lost = copied
    for is_hot, marks in ((False, twice & ~often), (True, often)):
        if not marks.any():
            continue
        marked = spark.sparkContext.broadcast(marks)
        digests = _digests(rows, length, marked, firsts, bits)
        if is_hot:
            settled = _hot_classes(materialise(digests, "hot-digests"))
        else:
            settled = digests.repartition(parts, "anchor").sortWithinPartitions("anchor", "off", "h", "g", *by).mapInArrow(_classes(), SETTLED)
        settled = materialise(settled, "settled")
        lost = lost.unionByName(settled.where("b is not null"))
        needed = key_filter(settled.where("b is null").select("__id", "__tag", F.col("a").alias("lo")), FIRST_BITS, _places)
        if needed.any():
            bodies = _bodies(rows, length, spark.sparkContext.broadcast(needed), marked, firsts, bits)
            lost = lost.unionByName(_hot_lost(materialise(bodies, "hot"), length) if is_hot else bodies.repartition(parts, "anchor").sortWithinPartitions("anchor", *by).mapInArrow(_compare(length), LOST))
    # a copy of an equal row would give its stretches twice; they are joined below in any case
    lost = lost.groupBy("__id", "__tag").agg(F.collect_list(F.struct("a", "b")).alias("__lost")).withColumnRenamed("__id", "__lid").withColumnRenamed("__tag", "__ltag")
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    own = docs.drop(*names)
    met = own.withColumn("__tag", tag).join(lost, F.col(id_column).cast("long").eqNullSafe(F.col("__lid")) & (F.col("__tag") == F.col("__ltag")), "left")
    fields = own.schema.fields
    schema = T.StructType([*fields, *(T.StructField(n, T.BinaryType() if n == "kept" else T.LongType()) for n in names)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept, texts = [], [], [], [], []
            at = b.column(b.schema.get_field_index(text_column))
            for t, spans in zip(at.cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                t = t or b""
                spans = _joined([(x["a"], x["b"]) for x in spans]) if spans else []
                n_bytes.append(len(t))
                n_spans.append(len(spans))
                n_removed.append(sum(y - x for x, y in spans))
                parts, whole, last, wlast = [], [], 0, 0
                for x, y in spans:
                    parts.append(t[last:x])
                    last = y
                    while x < y and t[x] & 0xC0 == 0x80:  # not at a character's start
                        x += 1
                    while x < y < len(t) and t[y] & 0xC0 == 0x80:
                        y -= 1
                    whole.append(t[wlast:x])
                    wlast = y
                kept.append(b"".join([*parts, t[last:]]))
                texts.append(b"".join([*whole, t[wlast:]]).decode("utf-8", "replace"))
            columns = [pa.array(texts, pa.string()) if f.name == text_column else b.column(i) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return met.select(*[F.col(f"`{f.name}`") for f in fields], "__lost").mapInArrow(remove, schema)
