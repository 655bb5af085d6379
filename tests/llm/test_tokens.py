"""SentencePiece encoding and packing, against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import pairs

from quadrille.llm import packing, queries, sentencepieces

SEED = random.Random(4)
ALPHABET = ["a", "a", "b", " ", "  ", "é", "▁", "\n", "\t", "the", " in", "er", "ß", "漢", "ﷺ", "😀", "0", "<s>", "'s", "'", "<|endoftext|>", "\x0b", "\x85", "İ", "Σ", "́", ".,!"]


@pytest.fixture(scope="module")
def samples(texts):
    odd = ["".join(SEED.choice(ALPHABET) for _ in range(SEED.randrange(30))) for _ in range(3000)]
    odd += ["a" * 4000, " " * 2000, "ab" * 2000, "the" * 2000, "", " ", "x y  z   "]
    return [*texts.values(), *odd, *(t or "" for _, t in pairs())]


@pytest.fixture(scope="module")
def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))


def test_pieces_as_the_library(samples, piece_model):
    own = sentencepieces.encoder(queries.tokenizer_file("piece_bpe_32k.model"))
    for t in samples:
        want = piece_model.encode(t)
        assert own.encode(t) == want
        assert own.decode(want)[1:] == piece_model.decode(want)


def test_memory_of_words_is_bounded(samples, monkeypatch):
    own = sentencepieces.PieceEncoder(queries.tokenizer_file("piece_bpe_32k.model"))
    want = [own.encode(t) for t in samples[:300]]
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 50)
    assert [own.encode(t) for t in samples[:300]] == want


def test_encoded(spark, edge, nothing, piece_model):
    got = sentencepieces.encoded(edge, queries.tokenizer_file("piece_bpe_32k.model")).collect()
    want = []
    for i, t in pairs():
        ids = piece_model.encode(t or "") + [piece_model.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece_model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sentencepieces.encoded(nothing, queries.tokenizer_file("piece_bpe_32k.model")).collect() == []


@pytest.fixture(scope="module")
def word_model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))


def test_words_as_the_library(samples, word_model):
    own = packing.WordTokens(queries.tokenizer_file("word_bpe_49k.json"))
    want = word_model.encode_batch(samples, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own(samples)] == [e.ids for e in want]


def least_sequences(histogram, capacity):
    """The optimum, by search; for small instances."""
    best = [sum(histogram.values())]

    def go(left, rooms):
        if len(rooms) >= best[0]:
            return
        if not left:
            best[0] = len(rooms)
            return
        n, rest = left[0], left[1:]
        for k in sorted(set(range(len(rooms))), key=lambda k: rooms[k]):
            if rooms[k] >= n and rooms[k] not in rooms[:k]:
                go(rest, [*rooms[:k], rooms[k] - n, *rooms[k + 1 :]])
        go(rest, [*rooms, capacity - n])

    go(sorted(Counter(histogram).elements(), reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 100])
    histogram = {rng.randint(1, capacity): rng.randint(1, 2 if seed < 40 else 50) for _ in range(rng.randint(1, 6))}
    combinations = packing.plan(histogram, capacity)
    used = Counter()
    for times, lengths in combinations:
        assert times > 0 and sum(lengths) <= capacity
        for n in lengths:
            used[n] += times
    assert used == Counter(histogram)
    total = sum(t for t, _ in combinations)
    if seed < 40:
        assert total <= least_sequences(histogram, capacity) + 1
    places = defaultdict(list)
    for n, first, last, sequence, offset, step, copies in packing.slots(combinations):
        for r in range(first, last + 1):
            places[sequence + (r - first) // copies].append((offset + (r - first) % copies * step, n))
    assert len(places) == total
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n


def test_dominating_sets():
    assert packing.dominating(Counter({8: 1}), [8], 9, 10) == ()
    assert packing.dominating(Counter({3: 1, 2: 1}), [2, 3], 7, 10) == (3,)
    assert packing.dominating(Counter({5: 1, 4: 1, 3: 1}), [3, 4, 5], 11, 20) == (5, 4)
    # A pair that fills a sequence, but does not dominate the longest single piece.
    pieces = Counter([1100, 940, 500, 448, 1000, 1000, 548, 600])
    assert packing.dominating(pieces - Counter([1100]), sorted(pieces - Counter([1100])), 1100, 2048) is None
    assert sum(t for t, _ in packing.plan(pieces, 2048)) == least_sequences(pieces, 2048) == 3


def test_reduction_loses_no_sequence():
    fixed = 0
    for seed in range(400):
        rng = random.Random(seed)
        capacity = rng.choice([20, 40, 100])
        histogram = Counter(rng.randint(capacity // 5, capacity if seed % 2 else capacity // 2) for _ in range(rng.randint(1, 9)))
        sets, left = packing.reduced(histogram, capacity)
        used = Counter()
        for times, lengths in sets:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] += times
        assert used + left == histogram
        count = sum(t for t, _ in sets)
        assert count + least_sequences(left, capacity) == least_sequences(histogram, capacity)
        fixed += sum(t for t, lengths in sets if 2 * lengths[0] <= capacity)
    assert fixed > 20  # lengths below half the capacity are reduced too


def test_a_plan_of_many_pieces_takes_few_steps():
    histogram = {n: 10**9 + n for n in range(1, 2049)}
    combinations = packing.plan(histogram, 2048)
    total = sum(n * c for n, c in histogram.items())
    assert len(combinations) < 20_000 and sum(t for t, _ in combinations) <= 1.01 * total / 2048


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed(edge, nothing, word_model, capacity):
    file = queries.tokenizer_file("word_bpe_49k.json")
    got = packing.packed(edge, file, capacity).collect()
    want = []
    for i, t in pairs():
        ids = np.array([*word_model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            want.append((i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= capacity
    # No two pieces over half the capacity share a sequence.
    least = max(-(-sum(r["length"] for r in got) // capacity), sum(2 * r["length"] > capacity for r in got))
    assert len(sequences) <= least + 1
    assert packing.packed(nothing, file, capacity).collect() == []
