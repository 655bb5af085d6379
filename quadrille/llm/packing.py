"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Documents become pieces of at most `capacity` tokens; how the pieces share
sequences depends on their lengths alone. So the plan is made on the histogram
of lengths, which has at most `capacity` entries whatever the input, and says how
often each combination of lengths is used. Each row of the plan (a *slot*) gives
a length's pieces of certain ranks their sequence and place; a piece's rank among
those of its length comes from counts by hash bucket, so no task has to see all
pieces of a common length.

Reduction: for each length, longest first, a set that dominates all others with a
piece of that length is fixed for good. A set dominates another if the other's
pieces can be dealt to its own so that none gets more than its length. Lengths
beside which three more pieces fit are not reduced. Best fit in order of falling
length packs what remains.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import ship, shuffle_partitions, written

#: Words remembered by a worker; a full memory is emptied.
REMEMBERED = 500_000
CHUNK = 4_000_000
#: Texts of these characters alone are cut into words here; the library itself takes all others.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The words of lower-case plain texts: contractions, runs of letters, single digits, runs of other signs.
_WORD = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordTokens:
    """Ids, as little-endian 32-bit bytes, by a tokenizer whose words are encoded apart; words are remembered."""

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.known: dict[str, bytes] = {}
        #: Whether an id ends a word.
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def _remember(self, words: list[str]) -> None:
        """Encode many words as one text; the ids that end a word tell them apart."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            self.known.update(zip(words, self._by_library(words), strict=True))
            return
        data, a = ids.tobytes(), 0
        for w, z in zip(words, (ends * 4).tolist(), strict=True):
            self.known[w] = data[a:z]
            a = z

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        words: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            plain = _PLAIN.fullmatch(t) and "<|" not in t
            words.append(_WORD.findall(t.lower()) if plain else None)
            if plain:
                new.update(set(words[-1]).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*(w for w in words if w))
        listed = list(new)
        for a in range(0, len(listed), 10_000):
            self._remember(listed[a : a + 10_000])
        known = self.known.__getitem__
        return [b"".join(map(known, w)) if w is not None else self._by_library([t])[0] for w, t in zip(words, texts, strict=True)]


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(file: str) -> WordTokens:
    if file not in _tokenizers:
        _tokenizers[file] = WordTokens(file)
    return _tokenizers[file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes) of each piece of each row of docs."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_file)
        for batch in batches:
            rows, at = [], 0
            names_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (size < CHUNK or not part):
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                for doc, data in zip(names_of[at : at + len(part)], tokens(part), strict=True):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[a : a + 4 * capacity]
                        rows.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own), *((own,) if ids else ())))
                at += len(part)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def dominating(left: Counter, lengths: list[int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths of a set that dominates, beside a piece of length `longest`; None if none is known to.

    `lengths` rises and holds each length of `left`, from which that piece is taken
    out. With at most two pieces beside it, the set takes the longest piece p that
    fits, and the longest q that fits then (if any does): another set's larger piece
    is at most p, and its smaller one at most q, or both together go into p.
    """
    room = capacity - longest
    if not lengths or lengths[0] > room:
        return ()
    p = lengths[bisect.bisect_right(lengths, room) - 1]
    if p == room:
        return (p,)
    least = []
    for n in lengths[:3]:
        least += [n] * min(3, left[n])
    if sum(least[:3]) <= room and len(least) > 2:
        return None
    k = bisect.bisect_right(lengths, room - p) - 1
    if k >= 0 and lengths[k] == p and left[p] < 2:
        k -= 1
    q = lengths[k] if k >= 0 else 0
    # The largest sum of two pieces that fit, both longer than q.
    low, high = bisect.bisect_right(lengths, q), bisect.bisect_right(lengths, room) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room or (low == high and left[lengths[low]] < 2):
            high -= 1
        elif total > p:
            return None
        else:
            low += 1
    return (p, q) if q else (p,)


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], Counter]:
    """(times, lengths) of the sets that are fixed, and how many pieces of each length are left.

    As pieces go, a set that dominates goes on to: there are only fewer others. So
    it is fixed as often as its lengths last.
    """
    left = Counter({n: c for n, c in histogram.items() if c})
    lengths = sorted(left)
    fixed: list[tuple[int, tuple[int, ...]]] = []
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            others = lengths if left[longest] else [n for n in lengths if n != longest]
            beside = dominating(left, others, longest, capacity)
            left[longest] += 1
            if beside is None:
                break
            used = (longest, *beside)
            need = Counter(used)
            times = min(left[n] // k for n, k in need.items())
            fixed.append((times, used))
            for n, k in need.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]
                    lengths.remove(n)
    return fixed, left


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths): combinations that use each length as often as the histogram says."""
    out, rest = reduced(histogram, capacity)

    # Best fit, by falling length, on runs of equal sequences: room -> [(lengths, times)].
    open_rooms: list[int] = []
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, used: tuple[int, ...], times: int) -> None:
        if room not in by_room:
            bisect.insort(open_rooms, room)
            by_room[room] = []
        by_room[room].append((used, times))

    for used_times, used in out:
        if sum(used) < capacity:
            put(capacity - sum(used), used, used_times)
    out = [x for x in out if sum(x[1]) == capacity]
    for n in sorted(rest, reverse=True):
        count = rest[n]
        while count:
            k = bisect.bisect_left(open_rooms, n)
            if k == len(open_rooms):
                each = capacity // n
                whole, part = divmod(count, each)
                if whole:
                    put(capacity - each * n, (n,) * each, whole)
                if part:
                    put(capacity - part * n, (n,) * part, 1)
                break
            room = open_rooms[k]
            used, times = by_room[room].pop()
            fit = min(room // n, count)
            now = min(times, count // fit)
            if now < times:
                by_room[room].append((used, times - now))
            elif not by_room[room]:
                del by_room[room]
                open_rooms.pop(k)
            put(room - fit * n, used + (n,) * fit, now)
            count -= fit * now
    out += [(t, used) for room in by_room.values() for used, t in room]
    return out


def slots(combinations: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first_rank, last_rank, first_sequence, offset, step, copies): places of pieces by rank.

    A combination used `times` times with a length `copies` times holds the ranks
    first_rank..last_rank: rank r goes to sequence first_sequence + (r - first_rank) // copies.
    """
    out, ranks, sequence = [], Counter(), 0
    for times, used in combinations:
        offset = 0
        for n in sorted(set(used), reverse=True):
            copies = used.count(n)
            first = ranks[n]
            ranks[n] += copies * times
            out.append((n, first, ranks[n] - 1, sequence, offset, n, copies))
            offset += copies * n
        sequence += times
    return out


def _before(keys: list[str], by: str) -> Column:
    """The sum of n over the rows of equal keys that come before a row."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and has the end id only. Repeated rows are packed
    each on its own; a null doc_id stays null; an empty table gives no rows. Equal
    lengths are told apart by rank, in no meaningful order. Other columns are not
    read.
    """
    spark = docs.sparkSession
    buckets = 16 * shuffle_partitions(spark)
    cut = written(pieces(docs, tokenizer_file, capacity, end_id).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = slots(plan(histogram, capacity))
    schema = "length long, first_rank long, last_rank long, first_sequence long, first_offset long, step long, copies long"
    table = spark.createDataFrame(places or [], schema)
    # Running counts go over chunks of buckets, then within each, so that no task has all buckets of a common length.
    counts = counts.withColumn("chunk", F.expr(f"bucket div {math.isqrt(buckets)}"))
    chunks = counts.groupBy("length", "chunk").agg(F.sum("n").alias("n")).select("length", "chunk", _before(["length"], "chunk").alias("base"))
    counts = counts.withColumn("own_base", _before(["length", "chunk"], "bucket")).join(chunks, ["length", "chunk"])
    counts = counts.select("length", "bucket", (F.col("base") + F.col("own_base")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(order) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    # The plan has a bounded number of rows (lengths and combinations of them, not pieces).
    fits = F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    out = ranked.join(F.broadcast(table).withColumnRenamed("length", "of_length"), (F.col("length") == F.col("of_length")) & fits)
    k = F.col("rank") - F.col("first_rank")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("copies")) * F.col("step")).cast("long").alias("offset"),
    )
