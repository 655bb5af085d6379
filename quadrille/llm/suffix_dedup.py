"""Substring dedup on bytes by a partitioned suffix array, sorted deep-shallow.

Suffixes count to a depth of `length` bytes, since a longer match is a row of
matches of that length. Each start belongs to the least hash among the k-mers of
its `length` bytes (its minimizer), so equal strings share a minimizer, and the
starts of a minimizer form runs. Blocks of documents ask which minimizers occur in
another block; only the runs of minimizers that two documents share are sent on,
to the partition of the suffix array that the minimizer belongs to. Runs that are
equal are combined before the shuffle: a block sends one of them. A minimizer of
more than HOT blocks (part of a line or passage that a large share of the documents
hold) would fill one partition with the texts around it; its starts go each to the
partition of its own string.

A partition sorts the runs that it gets by their first suffix. Equal ones are
neighbours then and go on as one; so does the smallest doc_id of those that have
it. Then it sorts all suffixes of these runs. Suffixes are dealt by their first two bytes; multikey quicksort on super-characters of eight bytes, for all
groups at once, sorts them to SHALLOW super-characters. What is still tied there,
and not alike, goes into blind tries, one a group, which compare each string with
one other in full; a leaf holds all copies of its string. Suffixes equal to the full depth are neighbours then; each start
learns whether the smallest doc_id of its string is below its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm import blocks
from quadrille.llm.common import ids_of, mixed, ship, shuffle_partitions

LENGTH = 50
#: Super-characters of the multikey quicksort; blind tries order what ties beyond.
SHALLOW = 3
#: Groups of the multikey quicksort that are sorted outright.
SMALL = 256
#: Blocks that share a minimizer before its runs are parted: parted runs take ten times the room.
HOT = 2000
#: Places whose minimizers are found at once.
CHUNK = 1 << 20


def kmer_words(length: int) -> int:
    """Eight-byte words in a k-mer: short enough to leave a choice of minimizers, long enough to be rare."""
    if length < 16:
        raise ValueError("matches of less than 16 bytes are not searched for")
    return max(1, min(3, length // 16))


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place, as numbers."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(kind).ravel()


def minimizers(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of `length` bytes: the least k-mer hash in them."""
    n, k = len(data) - length + 1, kmer_words(length)
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = _words(data)
    size = len(data) - 8 * k + 1
    hashed = word[:size] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, k):
        hashed ^= hashed >> np.uint64(32)
        hashed += word[8 * j : 8 * j + size]
        hashed *= np.uint64(0xD1342543DE82EF95)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    span, least = 1, hashed
    width = length - 8 * k + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    return least[:n]


class _Runs:
    """Runs of starts with one minimizer, in a block's documents in order of doc_id."""

    def __init__(self, table: pa.Table, length: int):
        self.block, self.ids, self.texts = blocks.read_block(table)
        self.data = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        parts = [self._part(np.frombuffer(self.data, np.uint8, offset=a), a, length) for a in range(0, len(self.data) - length + 1, CHUNK)]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.start, self.count, value = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        doc = np.searchsorted(self.ends, self.start, side="right")
        # Minimizers are small numbers by nature; mixed again, they fill the buckets evenly.
        self.keys, self.inverse = np.unique(mixed(value), return_inverse=True)
        low = np.full(len(self.keys), len(self.texts), np.int64)
        high = np.full(len(self.keys), -1, np.int64)
        np.minimum.at(low, self.inverse, doc)
        np.maximum.at(high, self.inverse, doc)
        self.several = low < high

    def _part(self, data: np.ndarray, at: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of starts and minimizer of each run among the CHUNK places from `at`; a run ends there at the latest."""
        value = minimizers(data[: CHUNK + length - 1], length)
        n = len(value)
        inside = np.ones(n, bool)
        # The last length - 1 places of a document start nothing in it.
        for k in range(int(np.searchsorted(self.ends, at, side="right")), len(self.ends)):
            end = int(self.ends[k]) - at
            if end - length + 1 >= n:
                break
            inside[max(0, end - length + 1) : end] = False
        fresh = value[1:] != value[:-1]
        start = np.flatnonzero(inside & np.r_[True, fresh | ~inside[:-1]])
        last = np.flatnonzero(inside & np.r_[fresh | ~inside[1:], True])
        return start + at, last - start + 1, value[start]

    def shared(self, seen: np.ndarray, hot: np.ndarray, length: int) -> _Shared:
        """The runs whose minimizer two documents share. Those of a hot one come start by start, each with its string's own key."""
        runs = np.flatnonzero((seen | self.several)[self.inverse])
        start, count, key = self.start[runs], self.count[runs], self.keys[self.inverse[runs]]
        split = hot[self.inverse[runs]]
        if split.any():
            n = count[split]
            each = np.repeat(start[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, key = np.r_[start[~split], each], np.r_[key[~split], string_keys(self.data, each, length)]
            count = np.r_[count[~split], np.ones(len(each), np.int64)]
        order = np.lexsort((start, key))
        start, count, key = start[order], count[order], key[order]
        place: dict[bytes, int] = {}
        at, data = [], self.data
        for a, z in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True):
            at.append(place.setdefault(data[a:z], len(place)))
        at = np.array(at, np.int64)
        first = np.unique(at, return_index=True)[1] if len(at) else at
        return _Shared(start, count, key, self.ids[np.searchsorted(self.ends, start, side="right")], at, first)


@dataclass
class _Shared:
    """Runs to be compared: start, number of starts, key, doc_id, and place of the content; and each content's first run, in order of key."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    doc_id: np.ndarray
    at: np.ndarray
    first: np.ndarray


def string_keys(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each start."""
    places = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    out = np.zeros(len(starts), np.uint64)
    for at in [*range(0, length - 7, 8), length - 8]:
        out = mixed(out ^ np.ascontiguousarray(places[starts + at]).view(np.uint64).ravel(), at)
    return out


def blind_trie_order(tails: list[bytes]) -> list[list[int]]:
    """Indices of strings of one length in their order; equal strings share a list.

    A blind trie keeps branching bytes and depths only. A string goes down by
    them, is compared in full with the leaf it meets, and so learns the depth at
    which it branches off.
    """
    size = 8 * len(tails[0])
    # A leaf is [None, string, indices]; a branch is [depth, {byte: node}].
    root: list = [None, tails[0], [0]]
    for i in range(1, len(tails)):
        t = tails[i]
        node = root
        while node[0] is not None:
            node = node[1].get(t[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == t:
            node[2].append(i)
            continue
        depth = (size - (int.from_bytes(t) ^ int.from_bytes(other)).bit_length()) // 8
        node, above = root, None
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][t[node[0]]]
        if node[0] == depth:
            node[1][t[depth]] = [None, t, [i]]
            continue
        branch = [depth, {other[depth]: node, t[depth]: [None, t, [i]]}]
        if above is None:
            root = branch
        else:
            above[1][t[above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[2])
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def multikey_quicksort(word: np.ndarray, starts: np.ndarray, depths: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes from starts, sorted by `depths` super-characters; and whether each differs from the one before it.

    `word` holds the super-character from each place. Suffixes are dealt by their
    first two bytes, then all groups are parted at once, each by a pivot (the median
    of three): less, equal, greater. What is equal goes on to the next super-character.
    """
    first = (word[starts] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(first, kind="stable")
    new = np.ones(len(starts), bool)
    new[1:] = first[order][1:] != first[order][:-1]
    sizes = np.diff(np.flatnonzero(np.r_[new, True]))
    depth = np.zeros(len(sizes), np.int64)
    at = np.arange(len(starts))  # places in `order` that are not sorted yet
    while True:
        rest = []
        open_groups = (sizes > 1) & (depth < depths)
        for part, chosen in ((_small_sorted, open_groups & (sizes <= SMALL)), (_parted, open_groups & (sizes > SMALL))):
            own_at = at[np.repeat(chosen, sizes)]
            if len(own_at):
                own = order[own_at]
                key = word[starts[own] + 8 * np.repeat(depth[chosen], sizes[chosen])]
                moved, new_sizes, deeper = part(key, sizes[chosen])
                order[own_at] = own[moved]
                new[own_at[np.cumsum(new_sizes) - new_sizes]] = True
                of = np.repeat(depth[chosen], deeper[0])
                rest.append((own_at, new_sizes, of + deeper[1]))
        if not rest:
            return order, new
        at, sizes, depth = (np.concatenate(x) for x in zip(*rest, strict=True))


def _small_sorted(key: np.ndarray, sizes: np.ndarray):
    """Groups sorted outright: the new order, the sizes of the parts of equal keys, and for each group how many these are, for each part whether it goes deeper."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((key, group))
    key = key[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return order, np.diff(np.r_[first, len(key)]), (np.bincount(group[first]), 1)


def _parted(key: np.ndarray, sizes: np.ndarray):
    """Groups parted by a pivot each, as _small_sorted; the parts are those less, equal and greater. Only equal ones go deeper."""
    begin = np.cumsum(sizes) - sizes
    a, b, c = key[begin], key[begin + sizes // 2], key[begin + sizes - 1]
    pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), sizes)
    # A part's members keep their order: parts are collected, then dealt to their groups.
    side = (key > pivot).astype(np.int8) * 2 + (key == pivot)
    parts = [np.flatnonzero(side == k) for k in range(3)]
    counts = np.stack([np.add.reduceat(side == k, begin, dtype=np.int64) for k in range(3)], 1)
    place = (np.cumsum(counts) - counts.ravel()).reshape(-1, 3)
    order = np.empty(len(key), np.int64)
    for k, own in enumerate(parts):
        n = counts[:, k]
        order[np.arange(len(own)) + np.repeat(place[:, k] - (np.cumsum(n) - n), n)] = own
    used = counts.ravel() > 0
    return order, counts.ravel()[used], (used.reshape(-1, 3).sum(1), np.tile([0, 1, 0], len(sizes))[used])


def super_characters(text: bytes) -> np.ndarray:
    return _words(np.frombuffer(text, np.uint8)).byteswap(inplace=True)


def deep_shallow(text: bytes, word: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes from starts, sorted by their first `length` bytes; and whether each differs from the one before it."""
    depth = min(SHALLOW, length // 8)
    order, new = multikey_quicksort(word, starts, depth)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(order)])
    deep = 8 * depth
    # Groups whose suffixes are all alike need no trie.
    alike = np.ones(len(order), bool)
    for at in [*range(deep, length - 7, 8), length - 8]:
        key = word[starts[order] + at]
        alike[1:] &= key[1:] == key[:-1]
    alike[first] = True
    tied = (size > 1) & ~np.logical_and.reduceat(alike, first)
    for a, n in zip(first[tied].tolist(), size[tied].tolist(), strict=True):
        own = order[a : a + n]
        leaves: dict[bytes, list[int]] = {}
        for i, p in enumerate(starts[own].tolist()):
            leaves.setdefault(text[p + deep : p + length], []).append(i)
        copies = list(leaves.values())
        ranked = [copies[i] for (i,) in blind_trie_order(list(leaves))]
        order[a : a + n] = own[[i for same in ranked for i in same]]
        new[a + np.cumsum([len(same) for same in ranked[:-1]])] = True
    return order, new


def equal_runs(text: bytes, word: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by their first suffix, then their number of starts; and whether each differs, to its last byte, from the one before it."""
    order, new = deep_shallow(text, word, at, length)
    group = np.cumsum(new)
    by = np.lexsort((count[order], group))
    order, group = order[by], group[by]
    a, n = at[order], count[order]
    same = (group[1:] == group[:-1]) & (n[1:] == n[:-1])
    size = n[1:] + length - 1
    for offset in range(length, int(n.max()) + length - 1, 8):
        left = np.flatnonzero(same & (size > offset))
        if not len(left):
            break
        place = np.minimum(offset, size[left] - 8)
        same[left] = word[a[1:][left] + place] == word[a[:-1][left] + place]
    return order, np.r_[True, ~same]


def _marked(table: pa.Table, length: int) -> pa.Table:
    """One partition: for each asking row, bits of the starts whose string a smaller doc_id has."""
    counts, owners, texts, asked = [], [], [], []
    for data in table.column("data").to_pylist():
        n = int.from_bytes(data[:8], "little")
        counts.append(np.frombuffer(data, np.int32, n, 8) - (length - 1))
        owners.append(np.frombuffer(data, np.int64, n, 8 + 4 * n))
        texts.append(data[8 + 12 * n :])
        asked.append(int(counts[-1].sum()))
    count, owner, text = np.concatenate(counts).astype(np.int64), np.concatenate(owners), b"".join(texts)
    del texts
    word = super_characters(text)
    # Runs lie one behind the other; the last length - 1 bytes of each start nothing.
    size = count + length - 1
    at = np.cumsum(size) - size
    order, new = equal_runs(text, word, at, count, length)
    first = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(owner[order], first)
    # The suffixes of one run of each kind, for the smallest doc_id that has it.
    kept = order[first]
    n = count[kept]
    begin = np.cumsum(n) - n
    starts = np.arange(int(n.sum())) + np.repeat(at[kept] - begin, n)
    order, new = deep_shallow(text, word, starts, length)
    first = np.flatnonzero(new)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(np.repeat(least, n)[order], first), np.diff(np.r_[first, len(order)]))
    own = np.arange(int(count.sum())) + np.repeat(begin[kind] - (np.cumsum(count) - count), count)
    repeated = smallest[own] < np.repeat(owner, count)
    ends = np.cumsum(asked)
    answers = [np.packbits(repeated[z - n : z]).tobytes() for n, z in zip(asked, ends.tolist(), strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(answers, pa.binary())})


def without_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with text, kept_text; with carry, carried.

    Each byte covered by a string of `length` bytes that also starts in a document
    of a smaller doc_id goes, judged on the input. A null text counts as empty;
    matches within a document, or among rows of one doc_id, remove nothing. A null
    doc_id is smaller than any other and stays null. An empty table gives no rows.
    Other columns are not read but those of carry, which come back in the struct
    carried, so their names may clash with any here. kept_text leaves out characters of which a part
    went.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = ids_of(docs)
    texts, _, total = blocks.text_blocks(docs, ids, carry)
    tasks = shuffle_partitions(spark)
    # A run starts every 14 bytes or so and takes 75 to send, where it is shared: 5 bytes
    # a byte of text at worst. Sorting takes 60 bytes a start.
    buckets = max(tasks, 3 * total // blocks.BUCKET_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        r = _Runs(table, length)
        return blocks.asked(r.block, r.keys, buckets)

    hot = HOT

    def seen_often(table: pa.Table) -> pa.Table:
        return blocks.seen_often(table, (1, hot))

    def send(table: pa.Table, seen: pa.Table) -> pa.Table:
        used, rows = [], []
        if table.num_rows and seen.num_rows:
            r = _Runs(table, length)
            x = r.shared(*blocks.answered_bits(seen, r.keys, buckets, 2), length)
            ends = blocks.bucket_ends(x.key[x.first], buckets)
            for b in np.flatnonzero(np.diff(ends)).tolist():
                own = x.first[ends[b] : ends[b + 1]]
                sizes = x.count[own] + length - 1
                parts = [r.data[a:z] for a, z in zip(x.start[own].tolist(), (x.start[own] + sizes).tolist(), strict=True)]
                rows.append(b"".join([len(own).to_bytes(8, "little"), sizes.astype(np.int32).tobytes(), x.doc_id[own].tobytes(), *parts]))
                used.append(b)
            block = r.block
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used) if used else [], pa.int64()), "data": pa.array(rows, pa.binary())})

    def mark(table: pa.Table) -> pa.Table:
        return _marked(table, length)

    def remove(table: pa.Table, both: pa.Table) -> pa.Table:
        if not table.num_rows:
            out = pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
            return out.append_column("carried", table.column("carried")) if carry else out
        r = _Runs(table, length)
        step = both.column("step").to_numpy() if both.num_rows else np.zeros(0, np.int32)
        x = r.shared(*blocks.answered_bits(both.filter(pa.array(step == 1)), r.keys, buckets, 2), length)
        change = np.zeros(len(r.data) + 1, np.int64)
        if len(x.first):
            count = x.count[x.first]
            begin = np.cumsum(count) - count
            limit = np.r_[begin, count.sum()]
            marks = np.zeros(limit[-1], bool)
            ends = blocks.bucket_ends(x.key[x.first], buckets)
            for b, data in blocks.answers(both.filter(pa.array(step == 2))).items():
                a, z = limit[ends[b]], limit[ends[b + 1]]
                marks[a:z] = np.unpackbits(np.frombuffer(data, np.uint8), count=z - a).astype(bool)
            # A later document's equal run is all repeats; the first one's marks hold for its own document.
            n = x.count
            later = np.repeat(x.doc_id > x.doc_id[x.first][x.at], n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = (np.repeat(x.start, n) + within)[later | marks[np.repeat(begin[x.at], n) + within]]
            change += np.bincount(start, minlength=len(change))
            change -= np.bincount(start + length, minlength=len(change))
        gone = np.cumsum(change[:-1]) > 0
        data = np.frombuffer(r.data, np.uint8)
        rows = []
        a = 0
        for z in r.ends.tolist():
            own = gone[a:z]
            out = data[a:z][~own].tobytes()
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + bool(len(own) and own[0])
            rows.append((z - a, z - a - len(out), spans, hashlib.sha256(out).hexdigest(), *((out.decode("utf-8", "ignore"),) if text else ())))
            a = z
        columns = [pa.array(r.ids, pa.int64()), *(pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
        out = pa.table(dict(zip(names, columns, strict=True)))
        return out.append_column("carried", blocks.in_order(table).column("carried")) if carry else out

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * text
    kinds = [pa.int64()] * 4 + [pa.string()] * (1 + text)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text
    schema += ", carried " + texts.schema["carried"].dataType.simpleString() if carry else ""
    by_block = texts.groupBy("block")
    seen = by_block.applyInArrow(ask, blocks.ASKED).groupBy("bucket").applyInArrow(seen_often, blocks.ANSWERS)
    sent = by_block.cogroup(seen.groupBy("block")).applyInArrow(send, blocks.ASKED).groupBy("bucket").applyInArrow(mark, blocks.ANSWERS)
    both = seen.selectExpr("block", "1 AS step", "bucket", "data").unionByName(sent.selectExpr("block", "2 AS step", "bucket", "data"))
    found = by_block.cogroup(both.groupBy("block")).applyInArrow(remove, schema)
    return found.withColumn("doc_id", ids.own("doc_id"))
