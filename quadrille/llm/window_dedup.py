"""Substring dedup on words: Rabin-Karp hashes of every window of a fixed number of words.

1. Each block of documents sends the hashes of its distinct windows, packed, to the
   buckets of a Spark exchange, which count the blocks that have each. A window that
   no other block has goes no further.
2. The windows left form runs of consecutive ones with a minimizer in common: the
   least hash of a few consecutive words inside. Equal windows have equal
   minimizers, so the runs' words, sent once a block to the minimizer's bucket, let
   it compare windows as words; it learns where each occurs first of all. A window
   of more than HOT blocks goes to the bucket of its own hash instead.
3. All windows but the first of all are repeats; overlapping ones merge into
   maximal intervals of words, which are removed.

Hashes are those of words under a key drawn for the run. They only choose what is
compared; what is removed was compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm import blocks
from quadrille.llm.common import ids_of, mixed, ship, shuffle_partitions
from quadrille.llm.words import WordCodes, equal_windows, new_key, windows, word_codes, word_hashes

WINDOW = 20
#: Blocks that share a window before it is parted from its neighbours.
HOT = 2000


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    span = 1
    while 2 * span <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (n - span)], values[n - span :]) if span < n else values


class _Windows:
    """The windows of a block, in order of doc_id and place."""

    def __init__(self, table: pa.Table, n: int, key: bytes):
        self.n = n
        self.block, self.ids, self.texts = blocks.read_block(table)
        self.counts, self.words, *self.spans = word_hashes(self.texts, key)
        self.word_ends = np.cumsum(self.counts)
        left = np.repeat(self.word_ends, self.counts) - np.arange(len(self.words))
        self.start = np.flatnonzero(left >= n)
        self.hashes = mixed(windows(self.words, n), 21)[self.start]
        self.keys, self.inverse, self.times = np.unique(self.hashes, return_inverse=True, return_counts=True)
        self.document = np.searchsorted(self.word_ends, self.start, side="right")
        self.place = self.start - np.r_[0, self.word_ends][self.document]

    def codes(self, starts: np.ndarray) -> np.ndarray:
        """Codes of the words in these windows, at their places."""
        change = np.bincount(starts, minlength=len(self.words) + 1) - np.bincount(starts + self.n, minlength=len(self.words) + 1)
        used = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        a, z = (x[used].tolist() for x in self.spans)
        of = np.searchsorted(self.word_ends, used, side="right").tolist()
        code = WordCodes().__getitem__
        out = np.zeros(len(self.words), np.int64)
        out[used] = [code(self.texts[i][p:q]) for i, p, q in zip(of, a, z, strict=True)]
        return out

    def runs(self, seen: np.ndarray, hot: np.ndarray) -> _Runs:
        """Runs of the windows that another block has; those of hot ones come one by one."""
        part = max(1, self.n // 5)
        least = _least(mixed(windows(self.words, part), 31), self.n - part + 1)[self.start]
        own = hot[self.inverse]
        keys = np.where(own, self.hashes, mixed(least, 32))
        at = np.flatnonzero(seen[self.inverse])
        start, key, document = self.start[at], keys[at], self.document[at]
        new = np.ones(len(at), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (key[1:] != key[:-1]) | (document[1:] != document[:-1]) | own[at][1:]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(at)])
        window = at[first]
        begin = self.start[window]
        a, z = self.spans[0][begin].tolist(), self.spans[1][begin + count + self.n - 2].tolist()
        document = self.document[window]
        ids, place, key = self.ids[document], self.place[window], keys[window]
        # Equal runs are sent once, for the first document and place of all.
        order = np.lexsort((place, ids, key))
        known: dict[bytes, int] = {}
        content = []
        texts = self.texts
        for r in order.tolist():
            content.append(known.setdefault(b" ".join(texts[document[r]][a[r] : z[r]].split()), len(known)))
        content = np.array(content, np.int64)
        leader = np.unique(content, return_index=True)[1] if len(content) else content
        return _Runs(window[order], count[order], key[order], ids[order], place[order], content, leader, list(known))

    def local(self, seen: np.ndarray) -> np.ndarray:
        """Windows that only this block has, and that are not the first of their kind in it."""
        again = np.flatnonzero((~seen & (self.times > 1))[self.inverse])
        if not len(again):
            return again
        group = equal_windows(self.codes(self.start[again]), self.start[again], self.n)
        ids, place = self.ids[self.document[again]], self.place[again]
        return again[_behind(group, ids, place)]


def _behind(group: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a member of a group comes after the group's first by (doc_id, place)."""
    order = np.lexsort((place, ids, group))
    first = order[np.r_[True, group[order][1:] != group[order][:-1]]]
    least_id, least_place = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    least_id[group[first]], least_place[group[first]] = ids[first], place[first]
    return (ids > least_id[group]) | ((ids == least_id[group]) & (place > least_place[group]))


class _Runs:
    """Runs in order of key: first window, number of windows, doc_id, place, and number of the content; each content's first run."""

    def __init__(self, window, count, key, ids, place, content, leader, contents):
        self.window, self.count, self.key, self.ids, self.place = window, count, key, ids, place
        self.content, self.leader, self.contents = content, leader, contents

    def sent(self, block: int, buckets: int) -> pa.Table:
        ends = blocks.bucket_ends(self.key[self.leader], buckets)
        used, rows = np.flatnonzero(np.diff(ends)).tolist(), []
        for b in used:
            own = self.leader[ends[b] : ends[b + 1]]
            parts = [self.contents[k] for k in range(ends[b], ends[b + 1])]
            sizes = np.array([len(p) for p in parts], np.int64)
            rows.append(b"".join([len(own).to_bytes(8, "little"), *(x.astype(np.int64).tobytes() for x in (self.count[own], sizes, self.ids[own], self.place[own])), *parts]))
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()), "data": pa.array(rows, pa.binary())})

    def repeats(self, both: pa.Table, buckets: int) -> np.ndarray:
        """The runs' windows that are not the first of all, by the buckets' answers."""
        count = self.count[self.leader]
        limit = np.r_[0, np.cumsum(count)]
        marks = np.zeros(limit[-1], bool)
        ends = blocks.bucket_ends(self.key[self.leader], buckets)
        for b, data in blocks.answers(both).items():
            a, z = limit[ends[b]], limit[ends[b + 1]]
            marks[a:z] = np.unpackbits(np.frombuffer(data, np.uint8), count=z - a).astype(bool)
        # A run equal to an earlier one is all repeats; the first one's marks hold for its own place.
        leader = self.leader[self.content]
        later = (self.ids > self.ids[leader]) | ((self.ids == self.ids[leader]) & (self.place > self.place[leader]))
        n = self.count
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = np.repeat(later, n) | marks[np.repeat(limit[self.content], n) + within]
        return (np.repeat(self.window, n) + within)[gone]


def _marked(table: pa.Table, n: int) -> pa.Table:
    """One bucket: for each asking row, bits of the windows that are not the first of all."""
    known: dict[bytes, int] = {}
    content, owner, place, asked, counts = [], [], [], [], []
    for data in table.column("data").to_pylist():
        k = int.from_bytes(data[:8], "little")
        count, sizes, ids, places = np.frombuffer(data, np.int64, 4 * k, 8).reshape(4, k)
        at = 8 + 32 * k
        for size in sizes.tolist():
            content.append(known.setdefault(data[at : at + size], len(known)))
            at += size
        owner.append(ids)
        place.append(places)
        counts.append(count)
        asked.append(k)
    content, owner, place, count = np.array(content, np.int64), np.concatenate(owner), np.concatenate(place), np.concatenate(counts)
    # The first place of each content, then of each window in all contents.
    order = np.lexsort((place, owner, content))
    first = order[np.r_[True, content[order][1:] != content[order][:-1]]]
    sizes, codes, _ = word_codes(list(known))
    del known
    windows_of = sizes - n + 1
    of = np.repeat(np.arange(len(sizes)), windows_of)
    begin = np.cumsum(windows_of) - windows_of
    within = np.arange(len(of)) - begin[of]
    group = equal_windows(codes, (np.cumsum(sizes) - sizes)[of] + within, n)
    ids, places = owner[first][of], place[first][of] + within
    order = np.lexsort((places, ids, group))
    least = order[np.r_[True, group[order][1:] != group[order][:-1]]]
    least_id, least_place = np.empty(len(least), np.int64), np.empty(len(least), np.int64)
    least_id[group[least]], least_place[group[least]] = ids[least], places[least]
    answers, k = [], 0
    for m in asked:
        c, times = content[k : k + m], count[k : k + m]
        offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        g = group[np.repeat(begin[c], times) + offset]
        doc, at = np.repeat(owner[k : k + m], times), np.repeat(place[k : k + m], times) + offset
        answers.append(np.packbits((doc > least_id[g]) | ((doc == least_id[g]) & (at > least_place[g]))).tobytes())
        k += m
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(answers, pa.binary())})


def without_repeats(docs: DataFrame, window: int = WINDOW, text: bool = False, key: bytes | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256; with text, kept_text (kept words, joined by one blank).

    A word is a run of characters other than [\\x20\\x09-\\x0D]; a null text has
    none. Of equal windows the one of the smallest doc_id, then the earliest, is
    kept. Rows that repeat a doc_id are the same document, and do not remove each
    other's windows at the same place. A null doc_id is smaller than any other and
    stays null. An empty table gives no rows. Other columns are not read. key is
    that of the hashes, drawn anew by default; rows do not depend on it.
    """
    spark = docs.sparkSession
    ship(spark)
    key = key or new_key()
    ids = ids_of(docs)
    texts, _, total = blocks.text_blocks(docs, ids)
    tasks = shuffle_partitions(spark)
    # A word takes 5 bytes with its blank: so many windows of 4 bytes, and runs of 20 a window where it is shared.
    buckets = max(tasks, total // blocks.BUCKET_BYTES)
    hot = HOT

    def ask(table: pa.Table) -> pa.Table:
        w = _Windows(table, window, key)
        return blocks.asked(w.block, w.keys, buckets)

    def seen_often(table: pa.Table) -> pa.Table:
        return blocks.seen_often(table, (1, hot))

    def send(table: pa.Table, seen: pa.Table) -> pa.Table:
        if not table.num_rows or not seen.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        w = _Windows(table, window, key)
        return w.runs(*blocks.answered_bits(seen, w.keys, buckets, 2)).sent(w.block, buckets)

    def mark(table: pa.Table) -> pa.Table:
        return _marked(table, window)

    def remove(table: pa.Table, both: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        w = _Windows(table, window, key)
        step = both.column("step").to_numpy() if both.num_rows else np.zeros(0, np.int32)
        seen, often = blocks.answered_bits(both.filter(pa.array(step == 1)), w.keys, buckets, 2)
        runs = w.runs(seen, often)
        repeats = np.concatenate([runs.repeats(both.filter(pa.array(step == 2)), buckets), w.local(seen)])
        total = len(w.words)
        change = np.bincount(w.start[repeats], minlength=total + 1) - np.bincount(w.start[repeats] + window, minlength=total + 1)
        gone = np.cumsum(change[:-1]) > 0
        removed, digests, kept = [], [], []
        a, z = w.spans
        for own, end, n in zip(w.texts, w.word_ends.tolist(), w.counts.tolist(), strict=True):
            stay = np.flatnonzero(~gone[end - n : end]) + end - n
            out = b" ".join([own[p:q] for p, q in zip(a[stay].tolist(), z[stay].tolist(), strict=True)]) if len(stay) < n else b" ".join(own.split())
            removed.append(n - len(stay))
            digests.append(hashlib.sha256(out).hexdigest())
            if text:
                kept.append(out.decode("utf-8", "replace"))
        columns = [pa.array(w.ids, pa.int64()), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.table(dict(zip(names, [*columns, *([pa.array(kept, pa.string())] if text else [])], strict=True)))

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    by_block = texts.groupBy("block")
    seen = by_block.applyInArrow(ask, blocks.ASKED).groupBy("bucket").applyInArrow(seen_often, blocks.ANSWERS)
    sent = by_block.cogroup(seen.groupBy("block")).applyInArrow(send, blocks.ASKED).groupBy("bucket").applyInArrow(mark, blocks.ANSWERS)
    both = seen.selectExpr("block", "1 AS step", "bucket", "data").unionByName(sent.selectExpr("block", "2 AS step", "bucket", "data"))
    found = by_block.cogroup(both.groupBy("block")).applyInArrow(remove, schema)
    return found.withColumn("doc_id", ids.own("doc_id"))
