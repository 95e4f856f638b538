"""Vectorised kernels over one sequence or many joined ones; all hashes are unsigned 64-bit.

Many sequences are one buffer with a byte between them that is no base, so a
k-mer never reaches from one into the next, and short reads cost no call each.
"""

from __future__ import annotations

import numpy as np

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _x, _y in zip(b"ACGTacgt", b"TGCATGCA", strict=True):
    _COMPLEMENT[_x] = _y

# Offset and prime of the FNV-1a hash.
FNV_OFFSET = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x100000001B3)

EMPTY = np.zeros(0, np.int64), np.zeros(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The invertible 64-bit integer mix: shifts and wrapping adds by 21, 24, 3 and 8, 14, 2 and 4, 28, 31."""
    s = [np.uint64(n) for n in (21, 24, 3, 8, 14, 2, 4, 28, 31)]
    with np.errstate(over="ignore"):
        x = ~x + (x << s[0])
        x = x ^ (x >> s[1])
        x = x + (x << s[2]) + (x << s[3])
        x = x ^ (x >> s[4])
        x = x + (x << s[5]) + (x << s[6])
        x = x ^ (x >> s[7])
        return x + (x << s[8])


def _wholly_valid(bad: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k without a bad base."""
    total = np.concatenate([[0], np.cumsum(bad)])
    return np.flatnonzero(total[k:] == total[:-k])


def _wide(c: np.ndarray, k: int) -> np.ndarray:
    """Two bits a base, for each window of k, by doubling."""
    done, at = None, 0
    power, width = c.astype(np.uint64), 1
    left = k
    while left:
        if left & 1:
            if done is None:
                done, at = power, width
            else:
                n = len(c) - (at + width) + 1
                done = (done[:n] << np.uint64(2 * width)) | power[at : at + n]
                at += width
        left >>= 1
        if left:
            n = len(power) - width
            power = (power[:n] << np.uint64(2 * width)) | power[width : width + n]
            width *= 2
    return done


def _fnv(b: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(b) - k + 1, FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ b[j : j + len(h)].astype(np.uint64)) * FNV_PRIME
    return h


def canonical_kmers(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of all k-mers of A, C, G, T: two bits a base up to 32 bases, else hashes of the bytes; the lesser of both strands."""
    if k <= 0 or len(seq) < k:
        return EMPTY
    b = np.frombuffer(seq, np.uint8)
    c = _CODE[b]
    at = _wholly_valid(c > 3, k)
    if not len(at):
        return EMPTY
    if k <= 32:
        forward = _wide(c & 3, k)[at]
        backward = _wide((3 - (c & 3))[::-1].copy(), k)[::-1][at]
    else:
        forward = _fnv(b, k)[at]
        backward = _fnv(_COMPLEMENT[b][::-1].copy(), k)[::-1][at]
    return at, np.minimum(forward, backward)


def kmer_hashes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, x = canonical_kmers(seq, k)
    return at, mix64(x)


def joined(seqs: list[bytes]) -> tuple[bytes, np.ndarray]:
    """One buffer of several sequences, and where each begins."""
    n = np.array([len(x) + 1 for x in seqs], np.int64)
    return b"\n".join(seqs), np.cumsum(n) - n


def kmers_of(seqs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, canonical value) of all k-mers."""
    buf, begin = joined(seqs)
    at, x = canonical_kmers(buf, k)
    row = np.searchsorted(begin, at, "right") - 1
    return row, at - begin[row], x


def _canonical(c: np.ndarray, k: int) -> np.ndarray:
    """The lesser of both strands at all starts, valid or not, of bases' codes."""
    c = c & 3
    return np.minimum(_wide(c, k), _wide((3 - c)[::-1].copy(), k)[::-1])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each window of w, by doubling."""
    width = 1
    while 2 * width <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: width - w], h[w - width :]) if width < w else h


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1... for n places each."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


#: Buckets of k-mers, and which share of a piece's k-mers makes a bucket hot, where it has so many.
BUCKETS, HOT_SHARE, HOT_LEAST = 2048, 32, 4096


def packed_kmers(seqs: list[bytes], k: int) -> list[tuple[int, bool, bytes, bytes]]:
    """(bucket, counted, n, data): the canonical k-mers, k at most 32, by a bucket that their least inner word makes.

    Neighbours mostly share it, so a bucket's k-mers are runs of bases: n has a
    byte for each run's k-mers but one, data two bits for each base.  A hot
    bucket has its distinct k-mers in data and their counts in n.
    """
    buf, _ = joined(seqs)
    c = _CODE[np.frombuffer(buf, np.uint8)]
    if len(c) < k:
        return []
    at = _wholly_valid(c > 3, k)
    if not len(at):
        return []
    m = min(k, 6 + k // 8)
    bucket = (mix64(_window_minima(mix64(_canonical(c, m)), k - m + 1)[at]) % np.uint64(BUCKETS)).astype(np.int64)
    out = []
    n = np.bincount(bucket, minlength=BUCKETS)
    for x in np.flatnonzero(n > max(HOT_LEAST, len(at) // HOT_SHARE)).tolist():
        mine = bucket == x
        code, times = np.unique(_canonical(c, k)[at[mine]], return_counts=True)
        out.append((x, True, times.astype("<i8").tobytes(), code.astype("<u8").tobytes()))
        at, bucket = at[~mine], bucket[~mine]
    if not len(at):
        return out
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])])
    first = np.flatnonzero(new | (numbered(np.cumsum(new)) % 256 == 0))
    n = np.diff(np.append(first, len(at)))
    order = np.argsort(bucket[first], kind="stable")
    first, n = first[order], n[order]
    owner = bucket[first]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    stop = np.append(begin[1:], len(owner))
    bases = n + k - 1
    size = -(-np.add.reduceat(bases, begin) // 4) * 4  # each bucket's bases begin with a byte
    to = np.cumsum(bases) - bases
    to += np.repeat(np.cumsum(size) - size - to[begin], stop - begin)
    flat = np.zeros(int(size.sum()), np.uint8)
    flat[_spread(to, bases)] = c[_spread(at[first], bases)]
    packed = (flat[0::4] << 6 | flat[1::4] << 4 | flat[2::4] << 2 | flat[3::4]).tobytes()
    n = (n - 1).astype(np.uint8)
    for x, a, z, p, q in zip(owner[begin].tolist(), begin.tolist(), stop.tolist(), ((np.cumsum(size) - size) // 4).tolist(), (np.cumsum(size) // 4).tolist(), strict=True):
        out.append((x, False, n[a:z].tobytes(), packed[p:q]))
    return out


def unpacked_kmers(n: list[bytes], data: list[bytes], k: int) -> np.ndarray:
    """The canonical k-mers of runs in packed_kmers' form."""
    if not n:
        return EMPTY[1]
    packed = np.frombuffer(b"".join(data), np.uint8)
    flat = np.empty(4 * len(packed), np.uint8)
    for i in range(4):
        flat[i::4] = packed >> (6 - 2 * i) & 3
    runs = np.frombuffer(b"".join(n), np.uint8).astype(np.int64) + 1
    count = np.array([len(x) for x in n])
    bases = runs + k - 1
    begin = np.cumsum(bases) - bases
    size = np.array([4 * len(x) for x in data])
    begin += np.repeat(np.cumsum(size) - size - begin[np.cumsum(count) - count], count)
    return _canonical(flat, k)[_spread(begin, runs)]


def _leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least hash of each window of w hashes, by doubling."""
    if w <= 0 or len(h) < w:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(h)), 1
    less = lambda a, b: np.where(h[b] < h[a], b, a)
    while 2 * width <= w:
        best = less(best[:-width], best[width:])
        width *= 2
    return less(best[: width - w], best[w - width :]) if width < w else best


def _minima(row: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Indices of window minima in order, each place once; windows don't reach over rows."""
    i = _leftmost_minima(h, w)
    if not len(i):
        return i
    i = i[row[w - 1 :] == row[: len(row) - w + 1]]
    return i[np.concatenate([[True], i[1:] != i[:-1]])] if len(i) else i


def minimizers_of(seqs: list[bytes], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, hash) of window minima in order, each hash once a sequence; none where there are fewer than w k-mers."""
    row, _, x = kmers_of(seqs, k)
    h = mix64(x)
    i = _minima(row, h, w)
    r, m = row[i], h[i]
    order = np.lexsort((i, m, r))
    first = order[np.concatenate([[True], (r[order][1:] != r[order][:-1]) | (m[order][1:] != m[order][:-1])])] if len(order) else order
    first.sort()
    return r[first], m[first]


def minimizer_positions_of(seqs: list[bytes], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, start) of the window minima, each place once; a hash may occur at several."""
    row, at, x = kmers_of(seqs, k)
    i = _minima(row, mix64(x), w)
    return row[i], at[i]


def minimizers_of_hashes(row: np.ndarray, h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): minima of windows over hashes that are left after filtering, sorted by row: only neighbours that are equal fall together, and fewer than w give their one minimum."""
    if not len(h) or w <= 0:
        return row[:0], h[:0]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    few = np.diff(np.append(begin, len(row))) < w
    i = _leftmost_minima(h, w)
    i = i[row[w - 1 :] == row[: len(row) - w + 1]] if len(i) else i
    r = np.concatenate([row[i], row[begin[few]]])
    m = np.concatenate([h[i], np.minimum.reduceat(h, begin)[few]])
    order = np.argsort(r, kind="stable")
    r, m = r[order], m[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (m[1:] != m[:-1])])
    return r[new], m[new]


def numbered(row: np.ndarray) -> np.ndarray:
    """0, 1, 2... within each stretch of equal rows."""
    if not len(row):
        return row
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))


def compress_runs(seq: bytes) -> tuple[bytes, np.ndarray]:
    """The sequence with one of each run of equal bytes, and where each run begins."""
    b = np.frombuffer(seq, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return b[at].tobytes(), at
