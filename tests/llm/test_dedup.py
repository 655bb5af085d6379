"""Near duplicates, repeated windows and repeated strings, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import pairs

from quadrille.llm import blocks, common, exact_dedup, graphs, near_dedup, sharding, suffix_dedup, window_dedup, words

LOW = -(2**63)


def split(text, lower=False):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def key(i):
    return LOW if i is None else i


def near_model(rows, k, percent):
    """doc_id -> (sizes of its sets, component)."""
    sets = []
    for _, t in rows:
        w = split(t, True)
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = [key(i) for i, _ in rows]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for n, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for m in holders[x]:
                common[m] += 1
            holders[x].append(n)
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                a, b = sorted((root(ids[n]), root(ids[m])))
                up[b] = a
    return sorted((i, len(s), root(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize(("shingle", "chunk"), [(4, 2_000_000), (5, 2_000_000), (5, 100)])
def test_near_duplicates(spark, edge, nothing, texts, monkeypatch, shingle, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", chunk)
    rows = [*pairs(), *((i + 1000, t) for i, t in texts.items())]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(pairs()) :], "doc_id long, text string"))
    got = near_dedup.near_duplicates(docs, shingle, 80).collect()
    assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in got) == near_model(rows, shingle, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(nothing, shingle).collect() == []


def test_a_chain_of_near_copies(spark):
    """Neighbours link, ends do not: one component, found through chunks as well."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(text)))
        text = [*text[8:], *(f"w{rng.randrange(10**9)}" for _ in range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_model(rows, 5, 80)
    assert {c for _, _, c in want} == {61}
    for chunk in (10**6, 1500):
        near_dedup.CHUNK_SHINGLES, before = chunk, near_dedup.CHUNK_SHINGLES
        got = near_dedup.near_duplicates(docs, 5, 80).collect()
        near_dedup.CHUNK_SHINGLES = before
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_linked_spans_all_links(percent):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 90, 60)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.95], rng.integers(0, 9999, int(rng.integers(0, 9)))]) for _ in range(60)]
    sets += [sets[3], base[:1], base[:2], np.zeros(0, np.int64)]
    n = len(sets)
    similar = lambda a, b: len(np.union1d(a, b)) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    for labels in (np.arange(n), np.arange(n) // 3):
        want = graph(labels, [(a, b) for a in range(n) for b in range(a) if similar(sets[a], sets[b])])
        found = near_dedup.linked(np.concatenate(sets), np.array([len(x) for x in sets]), percent, labels)
        assert all(similar(sets[p], sets[q]) for p, q in found)
        assert graph(labels, found) == want


def graph(labels, links):
    """The parts of a graph whose nodes of equal label are joined."""
    up = {int(x): int(x) for x in labels}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[root(int(labels[a]))] = root(int(labels[b]))
    return {frozenset(i for i in range(len(labels)) if root(int(labels[i])) == root(int(labels[j]))) for j in range(len(labels))}


def test_exact_shingles():
    texts = ["a b c d e", "A b  c d x", "a b", "a", "", "a b c", "b a", "a b c d a b c d a b c d", "  "]
    for k in (1, 2, 3, 4):
        codes, sizes = near_dedup.exact_shingles([t.encode() for t in texts], k)
        names, at = {}, 0
        for t, n in zip(texts, sizes.tolist()):
            w = split(t, True)
            own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
            assert n == len(own) == len(set(codes[at : at + n].tolist()))
            names.setdefault(t, (own, set(codes[at : at + n].tolist())))
            at += n
        for own, found in names.values():
            for other, found2 in names.values():
                assert len(own & other) == len(found & found2)


def morse(n, flip=0):
    """A word of the Thue-Morse sequence, whose polynomial hashes modulo powers of two equal those of its complement."""
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_under_plain_polynomials(spark, n):
    rng = random.Random(n)
    tail = [words_of(rng, 1) for _ in range(30)]
    x, y = morse(n), morse(n, 1)
    rows = [(5, x), (6, y), (7, " ".join([x, *tail])), (8, " ".join([y, *tail])), (9, " ".join([x, y] * 20)), (10, " ".join([y, x] * 20)), (11, " ".join([x, *tail[:20]])), (12, " ".join([y, *tail[:19]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 4, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_model(rows, 4, 80)
    assert next(r["component_id"] for r in got if r["doc_id"] == 6) == 6
    assert sorted(map(tuple, window_dedup.without_repeats(docs, 20).collect())) == window_model(rows, 20)


def words_of(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_a_collision_of_hashes_decides_nothing(spark, monkeypatch):
    """With a hash of the first byte alone, windows are still told apart by their words."""
    monkeypatch.setattr(words, "_hashed", lambda data, start, size, key: data[start].astype(np.uint64))
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ax", "ay", "bx", "by"]) for _ in range(30)) for _ in range(20)]
    texts += [texts[0], texts[1][:40], texts[2] + " ax " + texts[3]]
    table = blocks.pa.table({"block": blocks.pa.array([0] * len(texts)), "doc_id": blocks.pa.array(range(len(texts))), "text": blocks.pa.array([t.encode() for t in texts], blocks.pa.binary())})
    for n in (3, 20):
        w = window_dedup._Windows(table, n, bytes([n]))
        none = np.zeros(len(w.keys), bool)
        w.runs(none, none)
        first = {}
        want = []
        for d, t in enumerate(texts):
            s = t.split()
            for j in range(len(s) - n + 1):
                if first.setdefault(tuple(s[j : j + n]), (d, j)) != (d, j):
                    want.append((d, j))
        # As if another block had none of them, and as if it had all.
        local = w.local(none)
        assert sorted(zip(w.document[local].tolist(), w.place[local].tolist())) == want
        runs = w.runs(~none, none)
        sent = runs.sent(0, 3)
        answers = blocks.pa.concat_tables([window_dedup._marked(sent.slice(k, 1), n) for k in range(sent.num_rows)])
        again = runs.repeats(answers, 3)
        assert sorted(zip(w.document[again].tolist(), w.place[again].tolist())) == want


def test_documents_with_a_common_head_are_not_compared(spark):
    """A licence at the head of each, of half their shingles: nothing links, and the work grows with the input."""
    rng = random.Random(2)
    head = words_of(rng, 30)
    docs = [(f"{head} {words_of(rng, 30)}").encode() for _ in range(8000)]
    compared = []
    for n in (2000, 8000):
        codes, sizes = near_dedup.exact_shingles(docs[:n], 5)
        start = time.perf_counter()
        assert near_dedup.linked(codes, sizes, 80, np.arange(n)) == []
        compared.append(time.perf_counter() - start)
    assert compared[1] < 8 * compared[0] + 0.5


def test_recall_of_candidates_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85, planted among others."""
    rng = random.Random(11)
    rows = []
    for p in range(600):
        w = [f"p{p}x{k}" for k in range(100)]
        other = [*w[:-10], *(f"q{p}x{k}" for k in range(10 if p % 2 else 8))]  # 86 common of 106, or 104 of the union
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(other))]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    model = {i: c for i, _, c in near_model(rows, 5, 80)}
    pairs_at = [i for i in model if model[i] != i]
    assert len(pairs_at) == 600
    assert sum(found[i] == model[i] for i in pairs_at) / len(pairs_at) >= 0.99
    assert all(found[i] in (i, model[i]) for i in model)


def least_id_rows():
    """doc_ids at the lower end of the type, null among them."""
    low = -(2**63)
    rng = random.Random(12)
    base = words_of(rng, 60)
    return [(low, base), (None, base), (low + 1, base + " more"), (low + 3, base), (None, words_of(rng, 60)), (low, words_of(rng, 60)), (2**63 - 1, base)]


def test_the_least_id_is_not_null(spark):
    rows = least_id_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = [i for i, _ in rows]
    for found in (near_dedup.near_duplicates(docs, 5, 80), window_dedup.without_repeats(docs, 20), suffix_dedup.without_repeats(docs, 50), exact_dedup.exact_groups(docs), sharding.sharded(docs, 100)):
        assert Counter(r["doc_id"] for r in found.collect()) == Counter(ids)
    near = near_dedup.near_duplicates(docs, 5, 80).collect()
    assert {r["component_id"] for r in near} == {None, -(2**63)} or {r["component_id"] for r in near} == {None}
    assert {r["keep_id"] for r in exact_dedup.exact_groups(docs).collect() if r["group_size"] > 1} == {None}
    # The same rows with ids of the same order elsewhere: decisions agree.
    moved = {None: None, -(2**63): 1, -(2**63) + 1: 2, -(2**63) + 3: 4, 2**63 - 1: 9}
    other = spark.createDataFrame([(moved[i], t) for i, t in rows], "doc_id long, text string")
    for of in (lambda d: window_dedup.without_repeats(d, 20), lambda d: suffix_dedup.without_repeats(d, 50)):
        assert sorted((repr(moved[r[0]]), *r[1:]) for r in of(docs).collect()) == sorted((repr(r[0]), *r[1:]) for r in of(other).collect())


def test_many_rows_of_one_id(spark, monkeypatch):
    """Rows of one id (null, or repeated) are dealt to many blocks; equal rows too, beyond a block."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    rng = random.Random(13)
    passage = words_of(rng, 25)
    rows = [(None, f"{words_of(rng, 3)} {passage} {words_of(rng, 3)}") for _ in range(60)] + [(4, "the same row again " * 8)] * 60 + [(9, passage), (4, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = common.ids_of(docs)
    texts, count, _ = blocks.text_blocks(docs, known)
    used = {(r["doc_id"], r["block"]) for r in texts.collect()}
    assert count > 5 and len({b for i, b in used if i == 4}) > 5 and len({b for i, b in used if i == common.LEAST_ID}) > 5
    got = window_dedup.without_repeats(docs, 20, text=False).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == window_model(rows, 20)
    got = suffix_dedup.without_repeats(docs, 50).collect()
    assert sorted((key(r["doc_id"]), *r[1:5]) for r in got) == string_model(rows, 50)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[shape]
    rng.shuffle(links)
    up = {x: x for a, b in links if a != b for x in (a, b)}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["id"], r["root"]) for r in got) == sorted((i, root(i)) for i in up)


def window_model(rows, n):
    rows = sorted(((key(i), t or "") for i, t in rows), key=lambda x: (x[0], x[1].encode()))
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - n + 1):
            first[tuple(w[j : j + n])] = min((i, j), first.get(tuple(w[j : j + n]), (i, j)))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < (i, j):
                gone[j : j + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(20, 2 << 20), (20, 3000), (3, 3000)])
def test_windows(edge, nothing, monkeypatch, n, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    got = window_dedup.without_repeats(edge, n, text=True).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == window_model(pairs(), n)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert window_dedup.without_repeats(nothing, n).collect() == []


def test_windows_of_a_table(documents, texts):
    got = window_dedup.without_repeats(documents, 20).collect()
    assert sorted(map(tuple, got)) == window_model(list(texts.items()), 20)


def string_model(rows, n):
    first = {}
    data = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for j in range(len(b) - n + 1):
            s = b[j : j + n]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("n", "block", "hot"), [(50, 2 << 20, 200), (50, 3000, 200), (16, 3000, 200), (33, 20_000, 200), (50, 3000, 1), (16, 3000, 2)])
def test_strings(edge, nothing, monkeypatch, n, block, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    got = suffix_dedup.without_repeats(edge, n, text=True, carry=["doc_id", "block", "n_chars"]).collect()
    assert sorted((key(r["doc_id"]), *r[1:5]) for r in got) == string_model(pairs(), n)
    for r in got:
        assert r["carried"]["doc_id"] == r["doc_id"] and r["carried"]["block"] == "clash"
    assert suffix_dedup.without_repeats(nothing, n, carry=["block"]).collect() == []


def test_strings_of_a_table(documents, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    got = suffix_dedup.without_repeats(documents, 50).collect()
    assert sorted(map(tuple, got)) == string_model(list(texts.items()), 50)


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256))])
def test_deep_shallow_sorts_suffixes(alphabet):
    rng = random.Random(6)
    text = bytes(rng.choice(alphabet) for _ in range(3000))
    text = text + text[500:900] + b"\0" * 60 + text[:300]
    for n in (16, 50):
        starts = np.arange(len(text) - n + 1)
        order, new = suffix_dedup.deep_shallow(text, suffix_dedup.super_characters(text), starts, n)
        found = [text[i : i + n] for i in order.tolist()]
        assert found == sorted(text[i : i + n] for i in starts.tolist())
        assert new.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256))])
def test_multikey_quicksort(alphabet, monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(alphabet) for _ in range(2000))
    text += text[100:400] + text[:50] + b"\0" * 40 + b"\xff" * 40
    word = suffix_dedup._words(np.frombuffer(text, np.uint8)).byteswap()
    for depth, small in ((1, 64), (2, 1), (3, 64), (3, 4), (3, 1)):
        monkeypatch.setattr(suffix_dedup, "SMALL", small)
        starts = np.array([rng.randrange(len(text) - 8 * depth) for _ in range(1500)])
        order, new = suffix_dedup.multikey_quicksort(word, starts, depth)
        found = [text[i : i + 8 * depth] for i in starts[order].tolist()]
        assert found == sorted(found) and sorted(order.tolist()) == list(range(1500))
        assert new.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(1500)]


def test_equal_runs_are_neighbours():
    rng = random.Random(21)
    runs = [bytes(rng.choice(b"ab") for _ in range(rng.choice([20, 21, 40]))) for _ in range(60)]
    runs += [r[:20] + b"x" * 7 for r in runs] + [runs[rng.randrange(60)] for _ in range(200)] + [b"z" * 20] * 3
    rng.shuffle(runs)
    text = b"".join(runs)
    sizes = np.array([len(r) for r in runs])
    order, new = suffix_dedup.equal_runs(text, suffix_dedup.super_characters(text), np.cumsum(sizes) - sizes, sizes - 15, 16)
    found = [runs[i] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(runs)))
    assert all(n or found[k] == found[k - 1] for k, n in enumerate(new.tolist()))
    assert all(not n or k == 0 or found[k] != found[k - 1] for k, n in enumerate(new.tolist()))
    assert new.sum() < 200


def test_runs_hold_every_start_once(monkeypatch):
    rng = random.Random(10)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice([0, 10, 49, 50, 51, 300, 2000]))) for _ in range(60)] + [b"z" * 3000]
    table = blocks.pa.table({"block": blocks.pa.array([7] * 61), "doc_id": blocks.pa.array(range(61)), "text": blocks.pa.array(texts, blocks.pa.binary())})
    for chunk in (1 << 20, 333, 50):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        r = suffix_dedup._Runs(table, 50)
        found = [(int(s) + k, int(key)) for s, n, key in zip(r.start, r.count, r.keys[r.inverse]) for k in range(n)]
        own = [a + k for a, n in zip((r.ends - [len(t) for t in texts]).tolist(), map(len, texts)) for k in range(n - 49)]
        assert [p for p, _ in found] == own
        of = {}
        for p, key in found:  # equal strings have one minimizer
            assert of.setdefault(r.data[p : p + 50], key) == key


def test_blind_trie():
    rng = random.Random(7)
    for size in (1, 3, 12):
        for alphabet in (b"ab", bytes(range(256))):
            tails = [bytes(rng.choice(alphabet) for _ in range(size)) for _ in range(200)]
            ranked = suffix_dedup.blind_trie_order(tails)
            assert [tails[same[0]] for same in ranked] == sorted(set(tails))
            assert all(len({tails[i] for i in same}) == 1 for same in ranked)
            assert sorted(i for same in ranked for i in same) == list(range(200))


def test_words_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "é"]) for _ in range(rng.randrange(60))).encode() for _ in range(40)] + [b"z" * 700, b"", b" \n", b"q " * 400, b"\x0b\x0c\r x\x1cy\xc2\xa0z"]
    texts += [b"w" * n for n in (7, 8, 9, 16, 63, 64, 65, 66)] + [b"w" * 8 + b"\0", b"w" * 7 + b"\0"]
    read = lambda: words.word_hashes(texts, b"k", lower=True)
    counts, hashes, starts, ends = first = read()
    assert counts.tolist() == [len(split(t.decode())) for t in texts]
    of = {}
    a = 0
    for t, n in zip(texts, counts.tolist()):
        own = [t[i:j].decode() for i, j in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist())]
        assert own == split(t.decode())
        for w, h in zip(own, hashes[a : a + n].tolist()):
            assert of.setdefault(w.lower().replace("É", "é"), h) == h
        a += n
    assert len(set(of.values())) == len(of)
    codes = words.word_codes(texts, lower=True)
    assert codes[0].tolist() == counts.tolist() and len(set(zip(codes[1].tolist(), hashes.tolist()))) == codes[2] == len(of)
    monkeypatch.setattr(words, "CHUNK", 50)
    assert all((x == y).all() for x, y in zip(first, read()))
    assert (words.word_hashes(texts, b"other", lower=True)[1] != hashes).all()


def test_equal_windows_are_equal_by_code(monkeypatch):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 3, 400)
    starts = np.arange(397)
    by_hash = words.equal_windows(codes, starts, 4)
    monkeypatch.setattr(words, "windows", lambda values, n: np.zeros(len(values) - n + 1, np.uint64))
    for group in (by_hash, words.equal_windows(codes, starts, 4)):
        assert len({(g, *codes[i : i + 4].tolist()) for i, g in enumerate(group.tolist())}) == len(set(group.tolist())) == len({tuple(codes[i : i + 4].tolist()) for i in starts})
