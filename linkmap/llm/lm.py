"""Language-model scores from a causal self-attention model, trained and run in numpy.

Texts are lower-cased words, each cut into subword ids of a public vocabulary,
and an end.  The model sees windows of ids: embedding, one masked attention
layer over the window's earlier ids, and a softmax over classes of ids, to
which the last id's own row of logits is added; within its class the next id
is as likely as the training texts have it after the last one.  Windows
overlap, and each id is scored once, by the window in which it has the longer
past.

A word's probability is the model's product over its ids, with the chance that
the next id begins another word, mixed with its frequency in the training
texts, which has a share of ``SMOOTHING`` only.

What is learned from the corpus, all of it from all training texts:

* word counts, by an aggregate that combines before it shuffles;
* counts of neighbouring ids, by another; the model's tables (classes, the last
  id's logits, ids within classes) are the likeliest ones by these counts.  All
  pairs of an input and an id have their probability within the id's class: the
  ``PAIRS`` most frequent are broadcast, and words with others meet these in a
  join;
* the attention's weights, by gradient steps.  Texts are dealt by a hash of id
  and text into shards of about ``SHARD`` ids (more from ``MOST_SHARDS`` on, so
  that what is gathered has a bound) and into ``ROUNDS`` rounds.  In each round
  every shard is trained from the same start in the order of those hashes, and
  the shards' weights are averaged.  How rows lie in partitions thus makes no
  difference.

Both scores need each word's count.  The ``2**20`` most frequent words, among
them all that make up at least ``2**-20`` of all tokens, are
broadcast; the others meet their counts in a join, and none of them is a hot
key.

Defined results: a null text is empty and its one token is its end; a null id
counts as the empty string where texts are divided; every row gives a row,
repeated ones included; other columns are not carried; without training texts
all counts are zero and the weights are those of the start; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.llm.common import materialise, shared_dir, tune
from linkmap.llm.near_dup import mix, word_spans

HEAVY_BITS = 20
WINDOW, STRIDE, WIDTH = 16, 12, 8
#: Frequent ids that are classes of their own, and classes that share the others, half of which begin words.
OWN_CLASSES, MORE_CLASSES = 32, 16
#: Ids with embeddings of their own, and embeddings that the others share.
OWN_INPUTS, SHARED_INPUTS = 4096, 256
#: Pairs of an input and an id that are broadcast with the model.
PAIRS = 1 << 20
#: Taken off a pair's count, and classes' frequencies as so many sightings, where a row of counts is smoothed.
DISCOUNT, PRIOR = 0.75, 8.0
#: Ids of a shard, how many shards there are at most, and in how many rounds they are trained.
SHARD, MOST_SHARDS, ROUNDS = 1 << 22, 1 << 12, 8
#: How much of the class distribution is the model's; the rest is the classes' frequency.
TRUST = 0.995
#: How much of a word's probability is its frequency; the rest is the model's.
SMOOTHING = 0.05
#: Windows that are scored or trained on at a time.
BATCH = 256
#: Words that a worker remembers, and bytes of texts that are cut at a time.
CACHE, GROUP = 300_000, 1 << 23


@lru_cache(maxsize=1)
def _subwords(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # words are cut already, so the pattern only has to keep each whole
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _memo(path: str) -> dict[int, bytes]:
    """Words' subword ids by the words' hashes, as bytes of two-byte ids in the machine's order; forgets all when full."""
    return {}


def begins_word(path: str) -> np.ndarray:
    """Which ids begin a word: those whose bytes begin with a space, and the end."""
    e = _subwords(path)
    return np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(e.n_vocab)] + [True])


def n_ids(path: str) -> int:
    """Ids of the vocabulary, and one for the end."""
    return _subwords(path).n_vocab + 1


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GROUP bytes or one row: the more words are cut at a time, the more of them are alike."""
    held, size = [], 0
    for b in batches:
        for a in range(0, b.num_rows, 100):
            held.append(b.slice(a, 100))
            size += held[-1].nbytes
            if size > GROUP:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lowered(c: pa.Array) -> list[bytes]:
    return [t.lower() for t in c.cast(pa.binary()).to_pylist()]


def alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct hash is, and which of them each hash is; only hashes whose place in a table another one took are sorted."""
    n = len(hashes)
    bits = max(1, n.bit_length() - 1)
    slot, step = (hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange(n, dtype=np.int32)
    table = np.empty(1 << bits, np.int32)
    table[slot] = step
    own = table[slot]
    at = np.flatnonzero(own == step)
    number = np.empty(n, np.int64)
    number[at] = np.arange(len(at))
    which = number[own]
    rest = np.flatnonzero(hashes[own] != hashes)
    _, first, more = np.unique(hashes[rest], return_index=True, return_inverse=True)
    which[rest] = len(at) + more
    return np.append(at, rest[first]), which


class Cut:
    """Words and subword ids of some texts.  Each distinct word is looked at once: what most words cost is a hash and a place in a table."""

    def __init__(self, texts: list[bytes], path: str, end: int):
        buf = b" ".join(texts)
        hashes, start, stop = word_spans(buf)
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))
        at, which = alike(hashes)
        #: The distinct hashes, and which of them each token has; a text's end is one more.
        self.distinct = hashes[at]
        self._buf, self._start, self._stop = buf, start[at].tolist(), stop[at].tolist()
        self.which = np.insert(which, np.append(first[1:], len(hashes)), len(at))
        #: The first token of each text.
        self.first = first + np.arange(len(texts))
        memo, encode, found = _memo(path), _subwords(path).encode_ordinary, []
        if len(memo) >= CACHE:
            memo.clear()
        for h, a, b in zip(self.distinct.tolist(), self._start, self._stop, strict=True):
            ids = memo.get(h)
            if ids is None:
                ids = memo[h] = array("H", encode(" " + buf[a:b].decode("utf-8", "replace"))).tobytes()
            found.append(ids)
        table = np.append(np.frombuffer(b"".join(found), np.uint16), np.uint16(end))
        size = np.append(np.fromiter(map(len, found), np.int32, len(found)) // 2, np.int32(1))
        begin = np.cumsum(size, dtype=np.int32) - size
        n = size.take(self.which)
        place = np.cumsum(n) - n
        source = np.repeat(begin.take(self.which) - place, n)
        source += np.arange(len(source))
        #: The ids of each text.
        self.ids = np.split(table.take(source), place[self.first[1:]])

    def counts(self) -> pa.RecordBatch:
        """(h, word, n) of the distinct words."""
        n = np.bincount(self.which, minlength=len(self.distinct))[: len(self.distinct)]
        words = [self._buf[a:z] for a, z in zip(self._start, self._stop, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(self.distinct.view(np.int64)), pa.array(words, pa.binary()), pa.array(n)], names=["h", "word", "n"])


def text_ids(text: bytes, path: str, end: int) -> np.ndarray:
    return Cut([text.lower()], path, end).ids[0]


class Vocabulary:
    """Classes and inputs of ids, from how often training texts have them; begins says which ids begin a word."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.classes = OWN_CLASSES + MORE_CLASSES
        cls = np.empty(n, np.int64)
        cls[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
        at = OWN_CLASSES
        half = MORE_CLASSES // 2
        for kind in (True, False):  # the others in stretches of about equal mass
            ids = order[OWN_CLASSES:][begins[order[OWN_CLASSES:]] == kind]
            mass = np.cumsum(counts[ids] + 0.5)
            cls[ids] = at + np.minimum((mass - counts[ids] - 0.5) * half / mass[-1], half - 1).astype(np.int64)
            at += half
        self.cls, self.begins = cls, begins
        self.class_begins = np.zeros(self.classes, bool)
        self.class_begins[cls[begins]] = True
        mass = np.bincount(cls, weights=counts + 0.5, minlength=self.classes)
        self.within = (counts + 0.5) / mass[cls]
        self.share = mass / mass.sum()
        self.share_begins = float(self.share[self.class_begins].sum())
        self.inputs = np.empty(n, np.int64)
        self.inputs[order] = np.where(np.arange(n) < OWN_INPUTS, np.arange(n), OWN_INPUTS + np.arange(n) % SHARED_INPUTS)
        self.begin = OWN_INPUTS + SHARED_INPUTS


class Pairs:
    """Probabilities of ids within their class after the last input: those of the pairs given, and what all pairs leave to frequencies."""

    def __init__(self, voc: Vocabulary, seen: np.ndarray, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, distinct: np.ndarray | None = None):
        """Pairs (input, id, count), the counts of all (input, class), and of how many pairs these are, if others are elsewhere."""
        self.n = len(voc.cls)
        cls = voc.cls[ids]
        total = rows[seen, cls]
        share = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
        given = np.bincount(seen * voc.classes + cls, minlength=rows.size).reshape(rows.shape)
        if distinct is None:
            distinct = given
            self.left = 1.0 - np.bincount(seen * voc.classes + cls, weights=share, minlength=rows.size).reshape(rows.shape)
        else:
            self.left = np.where(distinct > 0, DISCOUNT * distinct / np.maximum(rows, 1), 1.0)
        np.clip(self.left, 1e-6, 1, out=self.left)
        #: Which (input, class) have pairs that are elsewhere.
        self.partial = distinct > given
        self.all_given = not self.partial.any()
        self.keys, self.share = seen * self.n + ids, share
        self.bits = max(4, int(np.ceil(np.log2(len(n) + 1))) + 2)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def table(self) -> None:
        """An open table of the pairs' keys, a quarter full."""
        full = (1 << self.bits) - 1
        self.at, self.value = np.full(full + 1, -1, np.int64), np.zeros(full + 1, np.float32)
        todo, slot = np.arange(len(self.keys)), self._slots(self.keys)
        while len(todo):
            free = self.at[slot] < 0
            where, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.at[where], self.value[where] = self.keys[todo[placed]], self.share[todo[placed]]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & full

    def log_within(self, seen: np.ndarray, ids: np.ndarray, voc: Vocabulary) -> np.ndarray:
        return np.log(self.within(seen, ids, voc)[0])

    def within(self, seen: np.ndarray, ids: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities by the pairs given, and the places whose pair may be elsewhere."""
        step = 1 << 14  # what a step holds stays in the processor's cache
        if len(ids) > step:
            parts = [(a, *self.within(seen[a : a + step], ids[a : a + step], voc)) for a in range(0, len(ids), step)]
            return np.concatenate([x for _, x, _ in parts]), np.concatenate([a + x for a, _, x in parts])
        keys = seen * self.n + ids
        slot = self._slots(keys)
        have = self.at.take(slot)
        hit = have == keys
        found = self.value.take(slot) * hit
        # most are told at once
        todo = np.flatnonzero(~hit & (have >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.at) - 1)
            have = self.at[slot]
            hit = have == keys[todo]
            found[todo[hit]] = self.value[slot[hit]]
            rest = ~hit & (have >= 0)
            todo, slot = todo[rest], slot[rest]
        cell = seen * voc.classes + voc.cls.take(ids)
        open_at = np.flatnonzero((found == 0) & self.partial.ravel().take(cell)) if not self.all_given else todo
        return found + self.left.ravel().take(cell) * voc.within.take(ids), open_at


def last_inputs(ids: np.ndarray, starts: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """The input before each id of texts that begin at starts."""
    out = np.empty(len(ids), np.int64)
    out[1:] = voc.inputs.take(ids[:-1])
    out[starts] = voc.begin
    return out


def windows(ids: np.ndarray, starts: np.ndarray, voc: Vocabulary, stride: int = STRIDE, inputs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, places of the targets, whether scored here) of the windows of texts that begin at starts, some at a time; inputs: those of all ids, if known."""
    n = np.diff(np.append(starts, len(ids)))
    count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if stride < WINDOW:  # texts' first windows together, as only they have all places scored
        order = np.argsort(number > 0, kind="stable")
        text, number = text[order], number[order]
    begin, end = starts[text] + number * stride, starts[text] + n[text]
    inputs = last_inputs(ids, starts, voc) if inputs is None else inputs
    step = np.arange(WINDOW)
    for a in range(0, len(text), BATCH):
        place = begin[a : a + BATCH, None] + step
        scored = place < end[a : a + BATCH, None]
        scored[:, : WINDOW - stride] &= (number[a : a + BATCH] == 0)[:, None]
        np.minimum(place, len(ids) - 1, out=place)
        yield inputs.take(place), place, scored


class Attention:
    """The weights: those that gradients train, and ``last``, the last input's own logits."""

    NAMES = ("embed", "place", "qkv", "out", "classes")
    _PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
    #: Exponents are held within this, so no maximum has to be taken out of them.
    _MOST = np.float32(30)
    #: Whether logits are known to be within it.
    within_bounds = False

    def __init__(self, voc: Vocabulary, rows: np.ndarray | None = None, seed: int = 11):
        """rows: the counts of (input, class); without them the last input says nothing."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=WIDTH**-0.5: rng.normal(size=shape, scale=s).astype(np.float32)
        self.p = {"embed": draw(voc.begin + 1, WIDTH, s=0.5), "place": draw(WINDOW, WIDTH, s=0.1), "qkv": draw(3, WIDTH, WIDTH), "out": draw(WIDTH, WIDTH), "classes": draw(WIDTH, voc.classes, s=0.01)}
        rows = np.zeros((voc.begin + 1, voc.classes)) if rows is None else rows
        self.last = np.log((rows + PRIOR * voc.share) / (rows.sum(1, keepdims=True) + PRIOR)).astype(np.float32)

    def _hold(self, x: np.ndarray) -> np.ndarray | None:
        """Hold exponents within the bounds; says which were beyond them, if any were."""
        if x.max(initial=0) <= self._MOST and x.min(initial=0) >= -self._MOST:
            return None
        out = np.abs(x) > self._MOST
        np.clip(x, -self._MOST, self._MOST, out=x)
        return out

    def joined(self) -> np.ndarray:
        """The matrices of queries (with the scale of their products), keys and values side by side."""
        q, k, v = self.p["qkv"]
        return np.concatenate([q * q.dtype.type(WIDTH**-0.5), k, v], axis=1)

    def project(self, seen: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """The windows' inputs, and their queries, keys and values side by side."""
        x = self.p["embed"].take(seen, axis=0)
        x += self.p["place"]
        return x, (x.reshape(-1, WIDTH) @ self.joined()).reshape(*seen.shape, 3 * WIDTH)

    def head(self, c: np.ndarray) -> np.ndarray:
        return np.tanh(c.reshape(-1, WIDTH) @ self.p["out"])

    def forward(self, seen: np.ndarray, since: int = 0):
        """What the layer makes of windows; of their places from since on."""
        x, d = self.project(seen)
        q, k, v = d[:, since:, :WIDTH], d[:, :, WIDTH : 2 * WIDTH], d[:, :, 2 * WIDTH :]
        s = q @ turned(k)
        self.held = self._hold(s)
        np.exp(s, out=s)
        s *= self._PAST[since:]
        total = (s.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), s.dtype)).reshape(len(s), -1, 1)
        c = s @ v
        c /= total
        return x, q, k, v, s, total, c, self.head(c)

    def exponents(self, h: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """In room that the next call takes again."""
        classes = self.p["classes"]
        z = np.matmul(h, classes, out=room("logits", len(h), classes.shape[1], h.dtype))
        z += self.last.take(seen, axis=0, out=room("last", len(h), classes.shape[1], self.last.dtype), mode="clip")
        self.held_logits = None if self.within_bounds else self._hold(z)
        return np.exp(z, out=z)

    def gradients(self, seen: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
        """The mean loss over the scored targets, and its gradients; that of ``embed`` is a row for each input."""
        p = self.p
        x, q, k, v, s, all_past, c, h = self.forward(seen)
        flat = seen.ravel()
        z = self.exponents(h, flat)
        weight = scored.ravel() / np.float32(max(1, int(scored.sum())))
        total = z @ np.ones((z.shape[1], 1), z.dtype)
        own = target.ravel() + np.arange(0, z.size, z.shape[1])
        loss = -float((np.log(np.maximum(z.ravel().take(own) / total[:, 0], 1e-30)) * weight).sum())
        # what each place's logits get, times its total and over its weight
        z.ravel()[own] -= total[:, 0]
        if self.held_logits is not None:
            z[self.held_logits] = 0
        weight = weight[:, None] / total
        g = {"classes": product(h * weight, z)}
        dh = z @ np.ascontiguousarray(p["classes"].T)
        dh *= weight
        dh *= 1 - h * h
        g["out"] = product(c.reshape(-1, WIDTH), dh)
        dc = (dh @ np.ascontiguousarray(p["out"].T)).reshape(c.shape)
        dc /= all_past
        ds = dc @ turned(v)
        ds -= ((dc * c).reshape(-1, WIDTH) @ np.ones((WIDTH, 1), c.dtype)).reshape(all_past.shape)
        ds *= s
        if self.held is not None:  # what is held doesn't change with its arguments
            ds[self.held] = 0
        d = np.empty((*x.shape[:2], 3 * WIDTH), x.dtype)
        np.matmul(ds, k, out=d[:, :, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
        np.matmul(s.transpose(0, 2, 1), dc, out=d[:, :, 2 * WIDTH :])
        d = d.reshape(-1, 3 * WIDTH)
        g["qkv"] = product(x.reshape(-1, WIDTH), d).reshape(WIDTH, 3, WIDTH).transpose(1, 0, 2)
        g["qkv"][0] *= d.dtype.type(WIDTH**-0.5)
        dx = d @ np.ascontiguousarray(self.joined().T)
        g["place"] = dx.reshape(x.shape).sum(0)
        cell = cells(len(p["embed"])).take(flat, axis=0).ravel()
        g["embed"] = np.bincount(cell, weights=dx.ravel(), minlength=p["embed"].size).reshape(-1, WIDTH).astype(dx.dtype)
        return loss, g


def turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a's columns times b's, a window's rows after another's: in one piece such long and thin products take several times as long."""
    step = math.gcd(len(a), 16 * WINDOW)
    return np.matmul(a.reshape(-1, step, a.shape[1]).transpose(0, 2, 1), b.reshape(-1, step, b.shape[1])).sum(0)


@lru_cache(maxsize=8)
def _room(name: str, columns: int, kind: np.dtype) -> np.ndarray:
    return np.empty((BATCH * WINDOW, columns), kind)


def room(name: str, rows: int, columns: int, kind: np.dtype) -> np.ndarray:
    """An array that the next call takes again: asking for new memory costs as much as filling it."""
    return _room(name, columns, kind)[:rows] if rows <= BATCH * WINDOW else np.empty((rows, columns), kind)


@lru_cache(maxsize=1)
def cells(rows: int) -> np.ndarray:
    """The places of rows' values, one after another."""
    return np.arange(rows * WIDTH).reshape(-1, WIDTH)


class Settled(Attention):
    """Weights that don't change any more: what they make of each input is computed once."""

    def __init__(self, model: Attention, voc: Vocabulary):
        self.p, self.last, self.voc = model.p, model.last, voc
        w = self.joined()
        w[:, 2 * WIDTH :] = w[:, 2 * WIDTH :] @ self.p["out"]
        self.of_input, self.of_place = self.p["embed"] @ w, self.p["place"] @ w
        self.sums = np.stack([np.ones(voc.classes), voc.class_begins], 1).astype(np.float32)
        # tanh() is at most 1, so mostly no logit can be beyond the bounds
        most = np.abs(self.p["classes"]).sum(0)
        self.within_bounds = bool((self.last.max(0) + most).max() < self._MOST and (self.last.min(0) - most).min() > -self._MOST)

    def project(self, seen: np.ndarray) -> tuple[None, np.ndarray]:
        d = self.of_input.take(seen, axis=0)
        d += self.of_place
        return None, d

    def head(self, c: np.ndarray) -> np.ndarray:
        return np.tanh(c.reshape(-1, WIDTH))  # the values have gone through ``out``

    def log_classes(self, seen: np.ndarray, scored: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms of what the scored targets' classes are given, and of what all classes that begin words are."""
        voc = self.voc
        since = 0 if scored[:, : WINDOW - STRIDE].any() else WINDOW - STRIDE
        at = np.flatnonzero(scored[:, since:])
        z = self.exponents(self.forward(seen, since)[-1].take(at, axis=0), seen[:, since:].ravel().take(at))
        total, begin = (z @ self.sums).astype(np.float64).T
        own = z.ravel().take(cls + np.arange(0, z.size, z.shape[1])) / total
        return np.log(TRUST * own + (1 - TRUST) * voc.share.take(cls)), np.log(TRUST * (begin / total) + (1 - TRUST) * voc.share_begins)


class Adam:
    """Steps of weights with their moments; an input's embedding has one second moment for all of its row."""

    def __init__(self, model: Attention, rate: float = 0.03):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.v = {k: np.zeros_like(x[:, :1] if k == "embed" else x) for k, x in model.p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        scale = np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t) / np.sqrt(1 + self.t / 300))
        for k, d in g.items():
            m, v = self.m[k], self.v[k]
            v *= np.float32(0.99)
            v += np.float32(0.01 / WIDTH) * ((d * d) @ np.ones((WIDTH, 1), d.dtype)) if k == "embed" else np.float32(0.01) * (d * d)
            m *= np.float32(0.9)
            d *= np.float32(0.1)
            m += d
            np.multiply(m, scale / (np.sqrt(v) + np.float32(1e-8)), out=d)
            self.model.p[k] -= d


def train_local(texts: Iterator[np.ndarray], voc: Vocabulary, adam: Adam) -> int:
    """Train on texts of ids, in windows that don't overlap; returns the number of ids."""
    n = 0
    held: list[np.ndarray] = []
    size = 0

    def run() -> None:
        starts = np.cumsum([0] + [len(x) for x in held[:-1]])
        ids = np.concatenate(held)
        cls = voc.cls[ids]
        for seen, place, scored in windows(ids, starts, voc, WINDOW):
            adam.step(adam.model.gradients(seen, cls.take(place), scored)[1])

    for x in texts:
        held.append(x)
        size += len(x)
        n += len(x)
        if size >= 1 << 18:
            run()
            held, size = [], 0
    if held:
        run()
    return n


def _sum_parts(df: DataFrame) -> dict[int, np.ndarray]:
    """Add up double vectors by ``part`` on the executors, in the order of ``shard``; what comes back is one vector for each part."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for x in pdf.sort_values("shard")["data"]:
            total = total + np.frombuffer(x, "<f8")
        return pd.DataFrame({"part": [key[0]], "data": [total.tobytes()]})

    return {r: np.frombuffer(bytes(x), "<f8") for r, x in df.groupBy("part").applyInPandas(add, "part int, data binary").collect()}


SUMS = "shard long, part int, data binary"


def _parts(vector: np.ndarray, shard: int = 0, n: int = 16) -> pa.RecordBatch:
    pieces = np.array_split(vector.astype("<f8"), n)
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["shard", "part", "data"])


def cut_ids(rows: DataFrame, path: str, end: int) -> tuple[DataFrame, DataFrame]:
    """(h, ids, round) of all texts, written by round: a hash of id and text, and the text's ids as two-byte numbers; and (h, word, n) of their words, from the same pass."""
    folder = shared_dir(rows.sparkSession, "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, data: list[bytes], number: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(data, pa.binary()), pa.array(number, pa.int32())], names=["h", "ids", "round"])

        for b in larger(batches):
            cut, h = Cut(lowered(b.column(1)), path, end), b.column(0).to_numpy()
            yield out(h, [x.tobytes() for x in cut.ids], (h >> 32) % ROUNDS)
            # a group's words are one row, of a round of their own
            words, sink = cut.counts(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, words.schema) as stream:
                stream.write_batch(words)
            yield out(np.zeros(1, np.int64), [sink.getvalue().to_pybytes()], np.array([-1]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(x).read_all().to_batches()

    dealt = rows.select(F.xxhash64("__id", "__text").alias("h"), "__text").mapInArrow(cut, "h long, ids binary, round int")
    dealt.write.partitionBy("round").parquet(folder)
    written = rows.sparkSession.read.schema("h long, ids binary, round int").parquet(folder)
    words = written.where(F.col("round") < 0).select("ids").mapInArrow(tell, "h long, word binary, n long")
    return written.where(F.col("round") >= 0), words.groupBy("h", "word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, end: int) -> DataFrame:
    """(a, b, n): how often id b follows a in the texts' ids; a is the end where b comes first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.uint32)
            last = np.concatenate([[np.uint32(end)], ids[:-1]])  # a text's last id is the end, which stands before the next one's first
            key, n = np.unique(last << np.uint32(16) | ids, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((key >> np.uint32(16)).astype(np.int32)), pa.array((key & np.uint32(0xFFFF)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, np.uint16))
                size += len(held[-1])
            if size >= 1 << 21:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return texts.select("ids").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def learn_tables(pairs: DataFrame, begins: np.ndarray, end: int, most: int | None = None) -> tuple[Vocabulary, np.ndarray, Pairs, DataFrame | None]:
    """Vocabulary, the counts of (input, class), the model's pairs, and, if there are more than are broadcast, (key, share) of the others; from the counts of all pairs of ids."""
    most = PAIRS if most is None else most
    counts = np.zeros(end + 1)
    for i, n in pairs.groupBy("b").agg(F.sum("n")).collect():  # a row for each id
        counts[i] = n
    voc = Vocabulary(counts, begins)
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(voc)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for b in batches:
            a, i, n = (np.array(c) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(a == end, voc.begin, voc.inputs[a])), pa.array(i.astype(np.int64)), pa.array(n)], names=["seen", "id", "n"])

    # ids that share an input share its pairs
    pairs = materialise(pairs.select("a", "b", "n").mapInArrow(take, "seen long, id long, n long").groupBy("seen", "id").agg(F.sum("n").alias("n")), "inputs")
    shape = (voc.begin + 1, voc.classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        total = np.zeros((2, *shape))
        for b in batches:
            seen, i, n = (np.array(c) for c in b.columns)
            np.add.at(total[0], (seen, voc.cls[i]), n)
            np.add.at(total[1], (seen, voc.cls[i]), 1)
        yield _parts(total.ravel())

    found = _sum_parts(pairs.mapInArrow(add, SUMS))
    rows, distinct = np.concatenate([found[k] for k in sorted(found)]).reshape(2, *shape) if found else np.zeros((2, *shape))
    top = pairs.orderBy(F.desc("n"), "seen", "id").limit(most).toArrow()
    seen, i, n = (top[c].to_numpy() for c in ("seen", "id", "n"))
    held = Pairs(voc, seen, i, n, rows, distinct)
    if held.all_given:
        return voc, rows, held, None
    s, j, k = (int(x[-1]) for x in (seen, i, n)) if len(n) else (-1, -1, 1 << 62)
    others = pairs.where((F.col("n") < k) | ((F.col("n") == k) & ((F.col("seen") > s) | ((F.col("seen") == s) & (F.col("id") > j)))))
    totals = spark.sparkContext.broadcast(rows)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for b in batches:
            seen, i, n = (np.array(c) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(seen * len(voc.cls) + i), pa.array((n - DISCOUNT) / totals.value[seen, voc.cls[i]])], names=["key", "share"])

    return voc, rows, held, others.mapInArrow(share, "key long, share double")


def train(texts: DataFrame, voc: Vocabulary, counts: np.ndarray) -> Attention:
    """One model from all shards, whose weights and second moments are averaged, by their ids, after each round."""
    spark = texts.sparkSession
    model = Attention(voc, counts)
    adam = Adam(model)
    shards = max(1, min(MOST_SHARDS, -(-int(counts.sum()) // SHARD)))
    n_parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fixed = spark.sparkContext.broadcast((voc, model.last))
    texts = texts.withColumn("shard", F.pmod("h", F.lit(shards)))
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast((model.p, adam.v, adam.t))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (voc, last), (p, v, t) = fixed.value, start.value
            rows = ((s, x) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for shard, group in groupby(rows, key=lambda x: x[0]):
                own = Attention.__new__(Attention)
                own.last, own.p = last, {k: x.copy() for k, x in p.items()}
                step = Adam(own)
                step.v, step.t = {k: x.copy() for k, x in v.items()}, t
                n = train_local((np.frombuffer(x, np.uint16) for _, x in group), voc, step)
                yield _parts(np.concatenate([[1, step.t - t, n]] + [n * x[k].ravel().astype(np.float64) for x in (own.p, step.v) for k in Attention.NAMES]), shard)

        part = texts.where(F.col("round") == k).repartitionById(n_parts, F.pmod("shard", F.lit(n_parts)).cast("int")).sortWithinPartitions("shard", "h", "ids")
        found = _sum_parts(part.select("shard", "ids").mapInArrow(fit, SUMS))
        start.unpersist()
        if not found:
            continue
        flat = np.concatenate([found[i] for i in sorted(found)])
        adam.t += round(flat[1] / flat[0])
        flat, at = flat[3:] / flat[2], 0
        for held in (model.p, adam.v):
            for name in Attention.NAMES:
                size = held[name].size
                held[name] = flat[at : at + size].reshape(held[name].shape).astype(np.float32)
                at += size
    return model


def word_scores(ids: list[np.ndarray], voc: Vocabulary, model: Attention, pairs: Pairs, elsewhere: list | None = None) -> list[np.ndarray]:
    """The model's log probability of each word of each text, and of its end.

    ``elsewhere`` takes arrays (word, key, probability) of the ids whose pair
    may be among those not given; words and ends count on over all texts, and
    the probability is the one within the class without that pair's share.
    """
    out: list[np.ndarray] = []
    model = Settled(model, voc)
    a = before = 0
    while a < len(ids):
        b, size = a, 0
        while b < len(ids) and (b == a or size < 1 << 18):
            size += len(ids[b])
            b += 1
        flat = np.concatenate(ids[a:b])
        starts = np.cumsum([0] + [len(x) for x in ids[a : b - 1]])
        own, begin = np.empty(len(flat)), np.empty(len(flat))
        cls, inputs, long = voc.cls[flat], last_inputs(flat, starts, voc), flat.astype(np.int64)
        for seen, place, scored in windows(flat, starts, voc, inputs=inputs):
            at = place[scored]
            own[at], begin[at] = model.log_classes(seen, scored, cls.take(at))
        within, open_at = pairs.within(inputs, long, voc)
        own += np.log(within)
        # a word: its ids, the first among those that begin words, and then an id that begins the next
        first = np.flatnonzero(voc.begins[flat])
        word = np.add.reduceat(own, first) - begin[first]
        if elsewhere is not None and len(open_at):
            elsewhere.append((np.searchsorted(first, open_at, "right") - 1 + before, inputs[open_at] * pairs.n + long[open_at], within[open_at]))
        before += len(first)
        last = np.zeros(len(first), bool)
        last[np.searchsorted(first, np.append(starts[1:], len(flat)) - 1)] = True
        after = np.append(begin[first[1:]], 0.0)
        word += np.where(last, 0.0, after)
        out += np.split(word, np.flatnonzero(last)[:-1] + 1)
        a = b
    return out


def least_count(by_hash: DataFrame, most: int) -> int:
    """The least count from which on there are no more than ``most`` words."""
    left, floor = most, None
    for n, words in sorted(by_hash.groupBy("n").count().collect(), reverse=True):  # few: their sum is at most that of all counts
        left -= words
        if left < 0:
            return n + 1
        floor = n
    return floor or 1


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


SCORED = "__id long, __row long, h long, tf int, sub double, own struct<held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"
#: What a row has besides where pairs are elsewhere: the word's place in its text, its count if known, the pair and the probability without it.
ELSEWHERE = ", pair struct<word:long,n:long,key:long,p:double>"


def with_others(scored: DataFrame, others: DataFrame) -> DataFrame:
    """The rows with one row for each word that waited for its pairs, and ``told``, the count of those that need no join for it."""
    pairs = scored.where(F.col("pair").isNotNull()).select("__id", "__row", "h", "sub", "pair.*").join(others, "key", "left")
    words = pairs.groupBy("__id", "__row", "word").agg(F.max("h").alias("h"), F.max("n").alias("told"), (F.sum("sub") + F.sum(F.log1p(F.coalesce("share", F.lit(0.0)) / F.col("p")))).alias("sub"))
    # frequent words have their count, and would be hot keys
    words = words.withColumn("h", F.when(F.col("told").isNull(), F.col("h")).otherwise(F.xxhash64("__row", "word")))
    return scored.where(F.col("pair").isNull()).drop("pair").unionByName(words.drop("word").withColumn("tf", F.lit(1)), allowMissingColumns=True)


def score(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", heavy_bits: int = HEAVY_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows."""
    spark = tune(docs.sparkSession)
    end = n_ids(path) - 1
    rows = docs.select(F.col(id_column).cast("long").alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    held_out = F.crc32(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    training = rows.where(~held_out)
    texts, words = cut_ids(training, path, end)
    words = materialise(words.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")), "words")
    n_train = training.count()
    by_hash = words.select("h", "n")
    v, n = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n")]).first()
    n_all, v_all = n + n_train, v + (n_train > 0)
    floor = least_count(by_hash, 1 << heavy_bits)
    top = by_hash.where(F.col("n") >= floor).toArrow().sort_by("h")  # 2**heavy_bits rows at most; as Arrow, for rows of Python take many times that
    voc, counts, pairs, others = learn_tables(materialise(pair_counts(texts, end), "pairs"), begins_word(path), end)
    model = train(texts, voc, counts)
    below = float(np.log10(n_all + 0.5 * (v_all + 1)))
    end_log = float(np.log10(n_train + 0.5))
    weight = SMOOTHING
    has_others = others is not None
    shared = spark.sparkContext.broadcast((top["h"].to_numpy(), top["n"].to_numpy(), voc, model, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, n_heavy, voc, own, pairs = shared.value
        pairs.table()
        # of the frequent words and, last, of the end
        n_told = np.append(n_heavy, n_train)
        logs = np.append(np.log10(n_heavy + 0.5), end_log)
        frequency = np.maximum(weight * n_told / max(n_all, 1), 1e-300)
        kind = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
        pair_kind = [("word", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("p", pa.float64())]
        structs = lambda columns, fields: pa.StructArray.from_arrays([pa.array(c, t, mask=m) for (c, m), (_, t) in zip(columns, fields, strict=True)], [x for x, _ in fields])
        for b in larger(batches):
            cut = Cut(lowered(b.column(2)), path, end)
            h = cut.distinct.view(np.int64)
            at = np.minimum(np.searchsorted(heavy, h), max(len(heavy) - 1, 0))
            hit = heavy[at] == h if len(heavy) else np.zeros(len(h), bool)
            place, told = np.append(at, len(heavy)).take(cut.which), np.append(hit, True).take(cut.which)
            elsewhere: list = []
            subs = np.concatenate(word_scores(cut.ids, voc, own, pairs, elsewhere))
            subs += np.log(1 - weight)
            n_tokens = np.diff(np.append(cut.first, len(subs)))
            text = np.repeat(np.arange(len(n_tokens)), n_tokens)
            # tokens with pairs that are elsewhere wait for these
            waits, key, p = (np.concatenate(x) for x in zip(*elsewhere, strict=True)) if elsewhere else (np.zeros(0, np.int64),) * 3
            done, rare = told.copy(), ~told
            done[waits] = rare[waits] = False
            known = done.copy()
            if not n_train:
                known[cut.first + n_tokens - 1] = False
            of_texts = lambda x: np.add.reduceat(x, cut.first)
            score = of_texts(np.where(done, np.log(frequency[place] + np.exp(subs)), 0.0)) / np.log(10)
            base = of_texts(np.where(done, logs[place], 0.0)) - n_tokens * below
            own_rows = structs([(x, None) for x in ([is_held_out(i) for i in b.column(0).to_pylist()], n_tokens, of_texts(known.astype(np.int64)), base, score)], kind)
            # a row for each such pair, of which a token's first one has its sum, one for each rare word, and the texts' own, with keys that no word has weight for
            first = np.append(True, waits[1:] != waits[:-1])[: len(waits)]
            rare = np.flatnonzero(rare)
            hashes = np.append(h, 0)
            of_text = np.concatenate([text[waits], text[rare], np.arange(len(n_tokens))])
            is_own = np.arange(len(of_text)) >= len(waits) + len(rare)
            out_h = np.concatenate([hashes[cut.which[waits]], hashes[cut.which[rare]], mix(b.column(1).to_numpy().astype(np.uint64) + np.uint64(1)).view(np.int64)])
            out_sub = np.concatenate([np.where(first, subs[waits], 0.0), subs[rare], np.zeros(len(n_tokens))])
            more = [pa.concat_arrays([structs([(waits - cut.first[text[waits]], None), (n_told[place[waits]], ~told[waits]), (key, None), (p, None)], pair_kind), pa.nulls(len(rare) + len(n_tokens), pa.struct(pair_kind))])] if has_others else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of_text)), b.column(1).take(pa.array(of_text)), pa.array(out_h), pa.array((~is_own).astype(np.int32)), pa.array(out_sub), own_rows.take(pa.array(of_text, mask=~is_own)), *more],
                names=["__id", "__row", "h", "tf", "sub", "own", "pair"][: 6 + len(more)],
            )

    scored = rows.select("__id", F.monotonically_increasing_id().alias("__row"), "__text").mapInArrow(run, SCORED + ELSEWHERE * has_others)
    told = F.lit(None).cast("long")
    if has_others:
        scored = with_others(materialise(scored, "scored"), others)
        told = F.col("told")
    known = scored.join(by_hash, "h", "left").select("__id", "__row", "tf", "sub", "own", F.coalesce(told, "n", F.lit(0)).alias("c"))
    # a word that is far too long for exp() has no frequency beside it either
    mixed = F.when(F.col("c") > 0, F.log10(F.lit(weight / max(n_all, 1)) * F.col("c") + F.exp("sub"))).otherwise(F.col("sub") / F.lit(float(np.log(10))))
    total = known.groupBy("__id", "__row").agg(
        F.bool_or("own.held_out").alias("held_out"),
        F.sum("own.n_tokens").alias("n_tokens"),
        (F.sum("own.n_known") + F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("own.base") + F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(0.5)))).alias("base_score"),
        (F.sum("own.score") + F.sum(F.when(F.col("tf") > 0, mixed).otherwise(0.0))).alias("score"),
    )
    return total.select(F.col("__id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
