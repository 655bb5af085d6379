"""MinHash near-duplicate detection with tensored banding.

* Signature: COLLECTIONS collections of ROWS minhashes each. A table's key joins
  two collections, so 16 collections of 3 give 120 tables of 6 rows from 48
  minhashes, where independent tables would take 720. Two sets of similarity 0.8
  share a table unless 15 of the 16 collections differ: about 2 in 10,000 at that
  threshold, and fewer above it.
* Equal sets are one class; only its smallest doc_id goes on.
* Tables: the members of a table's key are linked to the smallest of them, first
  within a batch and then among batches. The components of these links say which
  sets may have to be compared. No pairs of a group are listed.
* Verification: the texts of a component meet in one task, are cut into shingles as
  words, and are compared exactly. Only sets that share one of their rarest
  shingles are: two sets at the similarity share one among the
  n - ceil(n * similarity) + 1 rarest of either, so documents that have a common
  head, licence or footer and little else never meet.
* A component beyond CHUNK_SHINGLES is cut into chunks, each compared within itself
  and with the component's smallest member. If that leaves more than one part, the
  rarest shingles of its members, by counts over the component, become groups of
  their own, and the members of each group that has several parts are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import Ids, ids_of, mixed, ship, shuffle_partitions, written
from quadrille.llm.graphs import components
from quadrille.llm.words import new_key, windows, word_codes, word_hashes

COLLECTIONS = 16
ROWS = 3
#: Shingles of the sets that one task compares at once.
CHUNK_SHINGLES = 2_000_000
_MULTIPLIERS = mixed(np.arange(COLLECTIONS * ROWS, dtype=np.uint64), 5) | np.uint64(1)
_FIRST, _SECOND = np.triu_indices(COLLECTIONS, 1)


def shingle_sets(texts: list[bytes], shingle: int, key: bytes) -> list[np.ndarray]:
    """Each text's set of shingles, as sorted distinct hashes: `shingle` consecutive words, or all words where there are fewer."""
    out = []
    counts, words, _, _ = word_hashes(texts, key, lower=True)
    end = np.cumsum(counts)
    hashes = mixed(windows(words, shingle), 3)
    for a, z in zip((end - counts).tolist(), end.tolist(), strict=True):
        if z - a >= shingle:
            own = hashes[a : z - shingle + 1]
        elif z > a:
            own = mixed(windows(words[a:z], z - a), 1000 + z - a)
        else:
            own = hashes[:0]
        own = np.sort(own)
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash for each collection of minhashes."""
    least = np.full(len(_MULTIPLIERS), 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 8192):
        part = shingles[a : a + 8192] * _MULTIPLIERS[:, None]
        least = np.minimum(least, part.min(axis=1))
    least = least.reshape(COLLECTIONS, ROWS)
    key = np.zeros(COLLECTIONS, np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ least[:, k], k)
    return key


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, tables): keys of all pairs of collections."""
    tables = mixed(np.arange(len(_FIRST), dtype=np.uint64), 7)
    return mixed(mixed(signatures[:, _FIRST] ^ tables, 1) + signatures[:, _SECOND], 2)


def _signed(docs: DataFrame, ids: Ids, shingle: int, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column("doc_id"), batch.column("text")
            sizes, digests, signs = [], [], []
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (size < 1 << 20 or not part):
                    part.append(texts[at].as_py() or b"")
                    size += len(part[-1])
                    at += 1
                for s in shingle_sets(part, shingle, key):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    read = docs.select(ids.known().alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _firsts(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its smallest id, sorted by key; and links from the key's other ids to it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    least = ids[new][np.cumsum(new) - 1]
    other = least != ids
    return keys[new], ids[new], ids[other], least[other]


def _distinct_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new]


def candidate_links(classes: DataFrame, buckets: int) -> DataFrame:
    """classes: (id, signature). Links (a, b) that join the members of every table key."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint64).reshape(-1, COLLECTIONS)
                keys = table_keys(signs)
                keys, least, a, b = _firsts(keys.ravel(), np.repeat(ids, keys.shape[1]))
                a, b = _distinct_links(a, b)
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the key
                ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                link_ends = np.linspace(0, len(a), buckets + 1).astype(np.int64)
                blob = lambda x, ends: [x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(blob(keys, ends)), pa.array(blob(least, ends)), pa.array(blob(a, link_ends)), pa.array(blob(b, link_ends))], ["bucket", "keys", "ids", "a", "b"])

    def merged(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        _, _, a, b = _firsts(read("keys", np.uint64), read("ids", np.int64))
        a, b = _distinct_links(np.concatenate([a, read("a", np.int64)]), np.concatenate([b, read("b", np.int64)]))
        return pa.table({"a": a, "b": b})

    packed = classes.mapInArrow(entries, "bucket int, keys binary, ids binary, a binary, b binary")
    return packed.groupBy("bucket").applyInArrow(merged, "a long, b long")


def exact_shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingles of all texts as numbers, one after the other, and their sizes.

    Within one call, numbers are equal exactly where the words of the shingles are.
    """
    # Texts of fewer words are filled up with a number that no word has.
    counts, words, fill = word_codes(texts, lower=True)
    padded = np.full(len(words) + (shingle - 1) * len(texts), fill, np.int64)
    padded[np.arange(len(words)) + np.repeat(np.arange(len(texts)) * (shingle - 1), counts)] = words
    times = np.maximum(counts - shingle + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(texts)), times)
    begin = np.cumsum(counts + shingle - 1) - (counts + shingle - 1)
    at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + begin[of]
    name, span = np.zeros(len(at), np.int64), 1
    for j in range(shingle):
        if span * (fill + 1) >= 1 << 62:
            name = np.unique(name, return_inverse=True)[1]
            span = len(name)
        name = name * (fill + 1) + padded[at + j]
        span *= fill + 1
    name = np.unique(name, return_inverse=True)[1]
    order = np.lexsort((name, of))
    name, of = name[order], of[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
    return name[new], np.bincount(of[new], minlength=len(texts))


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's rarest members must hold one that any set at the similarity has among its own."""
    return sizes + percent * sizes // -100 + 1


def linked(codes: np.ndarray, sizes: np.ndarray, percent: int, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets, at least a spanning forest of all those at the similarity whose labels differ.

    Sets of equal label count as joined from the start. A set is held against the
    later ones of other parts that have one of its rarest members among theirs.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(n), sizes)
    often = np.bincount(codes)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    codes = rank[codes]
    codes = codes[np.lexsort((codes, owner))]
    inside = np.arange(len(codes)) - starts[owner] < prefix_sizes(sizes, percent)[owner]
    token, doc = codes[inside], owner[inside]
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    edges = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    group_end = edges[1:]
    several = np.flatnonzero(np.diff(edges)[group] > 1)
    own = several[np.argsort(doc[several], kind="stable")]
    own_ends = np.searchsorted(doc[own], np.arange(n + 1))
    part = np.unique(labels, return_inverse=True)[1].astype(np.int64)
    members = {int(k): x for k, x in enumerate(np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part))[:-1]))} if n else {}
    done = np.zeros(len(group_end), bool)
    marked = np.zeros(len(often), bool)
    out = []
    for p in range(n - 1):
        if len(members) == 1:
            break
        found = []
        for x in own[own_ends[p] : own_ends[p + 1]].tolist():
            g = group[x]
            if done[g]:
                continue
            later = doc[x + 1 : group_end[g]]
            other = later[part[later] != part[p]]
            if len(other):
                found.append(other)
            else:  # nor will any later set of the group find one
                done[g] = True
        if not found:
            continue
        later = np.unique(np.concatenate(found))
        later = later[100 * np.minimum(sizes[later], sizes[p]) >= percent * np.maximum(sizes[later], sizes[p])]
        if not len(later):
            continue
        mine = codes[starts[p] : ends[p]]
        marked[mine] = True
        many = sizes[later]
        first = np.cumsum(many) - many
        common = np.add.reduceat(marked[codes[np.arange(int(many.sum())) + np.repeat(starts[later] - first, many)]].astype(np.int64), first)
        marked[mine] = False
        for q in later[100 * common >= percent * (many + sizes[p] - common)].tolist():
            a, b = int(part[p]), int(part[q])
            if a != b:
                out.append((p, q))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                part[members[b]] = a
                members[a] = np.concatenate([members[a], members.pop(b)])
    return out


def _verified(docs: DataFrame, ids: Ids, places: DataFrame, shingle: int, percent: int, tasks: int) -> DataFrame:
    """places: (id, root, part, label), a row for each place where a set is compared. Links (a, b) by exact similarity."""

    def compare(table: pa.Table) -> pa.Table:
        order = table.sort_by([("root", "ascending"), ("part", "ascending"), ("id", "ascending")])
        root, part = order.column("root").to_numpy(), order.column("part").to_numpy()
        own, labels, texts = order.column("id").to_numpy(), order.column("label").to_numpy(), order.column("text")
        edges = np.flatnonzero((root[1:] != root[:-1]) | (part[1:] != part[:-1])) + 1
        a, b = [], []
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
            codes, sizes = exact_shingles(texts[i:j].to_pylist(), shingle)
            for p, q in linked(codes, sizes, percent, labels[i:j]):
                a.append(own[i + p])
                b.append(own[i + q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    where = places.groupBy("id").agg(F.collect_list(F.struct("root", "part", "label")).alias("places"))
    texts = docs.select(ids.known().alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    # The places grow with the input: both sides go by the shuffle at every size.
    shipped = texts.join(where.hint("merge"), "id").select("id", "text", F.inline("places"))
    shipped = shipped.withColumn("task", F.pmod(F.xxhash64("root", "part"), F.lit(tasks)))
    return shipped.groupBy("task").applyInArrow(compare, "a long, b long")


def _in_chunks(places: DataFrame) -> DataFrame:
    """places: (id, root, part, label, n). A group (root, part) beyond CHUNK_SHINGLES becomes groups for each two of its chunks."""
    weigh = places.groupBy("root", "part").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("long").alias("chunks"))
    cut = places.join(weigh, ["root", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    few = cut.where("chunks = 1").select("id", "root", "part", "label")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    many = cut.where("chunks > 1").select("*", other)
    pair = F.xxhash64("part", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return few.unionByName(many.where("chunk != other OR chunks = 1").select("id", "root", pair.alias("part"), "label")).distinct()


def _rare_groups(docs: DataFrame, ids: Ids, members: DataFrame, shingle: int, percent: int, key: bytes) -> DataFrame:
    """members: (id, root, label, n). Places (id, root, part, label, n): a part is a shingle that sets of different labels have among their rarest."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = shingle_sets([t.as_py() for t in part.column("text")], shingle, key)
                blobs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "root", "label")), blobs], ["id", "root", "label", "tokens"])

    texts = docs.select(ids.known().alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    read = texts.join(members.select("id", "root", "label").distinct().hint("merge"), "id").select("id", "root", "label", "text")
    sets = read.mapInArrow(tokens, "id long, root long, label long, tokens array<long>").withColumn("set", F.xxhash64("tokens"))
    sets = written(sets.dropDuplicates(["id", "set"]))
    rows = sets.select("id", "set", "root", "label", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    often = rows.groupBy("root", "token").agg(F.count("*").alias("often"), F.min("label").alias("x"), F.max("label").alias("y"))
    ranked = rows.join(often, ["root", "token"])
    # A window holds the shingles of one text.
    place = F.row_number().over(Window.partitionBy("id", "set").orderBy("often", "token"))
    rare = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("x != y")
    return rare.select("id", "root", F.col("token").alias("part"), "label", "n")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: bytes | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their whole
    shingle sets, compared as words. component_id is the smallest doc_id reachable,
    kept says that it is the document's own. A text that is null or has no word has
    an empty set and links with nothing. Rows that repeat a doc_id are one document
    with several sets. A null doc_id is smaller than any other and stays null. An
    empty table gives no rows. Other columns are not read. key is that of the hashes
    of words by which sets are classed and candidates found, drawn anew by default.
    """
    spark = docs.sparkSession
    ship(spark)
    key = key or new_key()
    known = ids_of(docs)
    tasks = shuffle_partitions(spark)
    rows = written(_signed(docs, known, shingle, key))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = written(classes)
    total, weight = classes.agg(F.count("*"), F.sum("n")).first()
    buckets = max(1, tasks, total * len(_FIRST) * 16 // (8 << 20))
    # A task holds some groups, of about a chunk in all or of one chunk each.
    compared = max(4 * tasks, 2 * (weight or 0) // CHUNK_SHINGLES)
    roots = components(candidate_links(classes.select("id", "signature"), buckets))

    # Chunks of large components; with more than one, each gets the smallest member too.
    weights = classes.select("id", "n").join(roots, "id")
    weigh = weights.groupBy("root").agg((F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("long").alias("chunks"))
    members = weights.join(weigh, "root").select("id", "root", "chunks", "n", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")).dropDuplicates(["id", "root", "chunk"])
    members = written(members)
    one = F.col("id").alias("label")
    first = members.select("id", "root", F.col("chunk").alias("part"), one)
    pivots = members.where("chunks > 1 AND id = root").select("id", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), one)
    links = written(_verified(docs, known, first.unionByName(pivots).distinct(), shingle, percent, compared))
    joined = components(links)
    large = members.where("chunks > 1")
    if not large.isEmpty():
        labelled = large.join(joined.select("id", F.col("root").alias("label")), "id", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "id"))
        several = labelled.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("root")
        rare = written(_rare_groups(docs, known, labelled.join(several, "root"), shingle, percent, key))
        more = _verified(docs, known, _in_chunks(rare), shingle, percent, compared)
        joined = components(written(links.unionByName(more)))

    ids = classes.select("digest", F.col("id").alias("class_id")).join(joined.withColumnRenamed("id", "class_id"), "class_id", "left")
    ids = ids.select("digest", F.coalesce("root", "class_id").alias("component"))
    found = rows.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(known.own("doc_id").alias("doc_id"), "n_shingles", known.own(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))
