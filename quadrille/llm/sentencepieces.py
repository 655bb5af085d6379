"""SentencePiece BPE by vectorised merge rounds.

The public model gives the pieces and their scores; the merging is done here, on
flat numpy arrays that hold the symbols of many words at once. In a round each
word finds its minimum pair rank and merges its pairs of that rank, leftmost
first and not overlapping; then the arrays are compacted and words without a
pair leave. Where a merge would bring up a pair of a lower rank than the round's,
only the word's leftmost pair is merged, as the sequential order would have it.

No piece holds a word mark behind another character, so merges never cross the
start of a word, and words can be encoded apart and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import ship

MARK = "▁"
_NONE = np.int64(1 << 40)
#: Symbols of characters outside the model: this plus the code point.
_OUTSIDE = 1 << 22
#: Words remembered by a worker; a full memory is emptied.
REMEMBERED = 600_000
#: Characters of text handled at once.
CHUNK = 1_000_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceEncoder:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.eos = model.eos_id()
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[p] = i
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the start of a word")
        order = sorted(normal.values(), key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        of = lambda s: normal.get(s, _OUTSIDE + ord(s) if len(s) == 1 else -1)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = of(p[:k]), of(p[k:])
                if a >= 0 and b >= 0:
                    pairs[(a << 24) | b] = (rank[i], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [0], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        self.shown = [str(i) for i in range(size)]
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        self.low, self.high = int(self.byte_ids.min()), int(self.byte_ids.max())
        self.breaks_lines = not any("\n" in p for p in normal)
        self.chars = np.arange(0x110000, dtype=np.int64) + _OUTSIDE
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.known: dict[str, tuple[str, str]] = {}

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE where there is none."""
        key = (a << 24) | b
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left in all words, and each word's number of them."""
        text = "".join(words)
        symbol = self.chars[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pair_ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nxt = np.minimum(at + 1, len(symbol) - 1)
            r, m = self._look_up(symbol[at], symbol[nxt])
            return np.where((nxt > at) & (word[at] == word[nxt]), r, _NONE), m

        rank, into = pair_ranks(np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(symbol)])
            least_of = np.repeat(least, size)
            over = least_of == _NONE
            if over.any():
                done.append((word[over], symbol[over]))
                symbol, word, rank, into, least_of = symbol[~over], word[~over], rank[~over], into[~over], least_of[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least_of)
            # Leftmost and not overlapping: every other one of a run of neighbours.
            new_run = np.r_[True, at[1:] != at[:-1] + 1]
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[in_run % 2 == 0]
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            if not first.all():
                at = at[first | self._safe(symbol, word, rank, into, at, first)]
            symbol[at] = into[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
            at = moved[at]
            mark = np.zeros(len(symbol), bool)
            mark[at] = True
            mark[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(mark)
            rank[changed], into[changed] = pair_ranks(changed)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate([x for x, _ in done])
        symbol = np.concatenate([x for _, x in done])
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _safe(self, symbol, word, rank, into, at, first) -> np.ndarray:
        """Whether all merges of a word, done at once, bring up no pair that would have come before them."""
        n = len(symbol)
        many = np.repeat(np.diff(np.r_[np.flatnonzero(first), len(at)]) > 1, np.diff(np.r_[np.flatnonzero(first), len(at)]))
        new = np.full(n, -1)
        new[at] = into[at]
        bad = np.zeros(len(at), bool)
        for left in (True, False):
            other = at - 1 if left else at + 2
            inside = (other >= 0) & (other < n)
            other = np.clip(other, 0, n - 1)
            inside &= word[other] == word[at]
            partner = np.clip(at - 2, 0, n - 1) if left else other
            for near in (symbol[other], np.where(new[partner] >= 0, new[partner], symbol[other])):
                r, _ = self._look_up(*((near, into[at]) if left else (into[at], near)))
                bad |= inside & (r < rank[at])
        group = np.cumsum(first) - 1
        return many & ~np.bincount(group, bad, minlength=group[-1] + 1).astype(bool)[group]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids end. Characters without a piece become their UTF-8 bytes."""
        symbol, count = self.merge(words)
        outside = np.flatnonzero(symbol >= _OUTSIDE)
        if len(outside):
            codes = [chr(x).encode("utf-8", "surrogatepass") for x in (symbol[outside] - _OUTSIDE).tolist()]
            width = np.ones(len(symbol), np.int64)
            width[outside] = [len(x) for x in codes]
            end = np.cumsum(width)
            ids = np.repeat(symbol, width)
            is_byte = np.repeat(symbol >= _OUTSIDE, width)
            ids[is_byte] = self.byte_ids[np.frombuffer(b"".join(codes), np.uint8)]
            ends = np.r_[0, end][np.cumsum(count)]
        else:
            ids, ends = symbol, np.cumsum(count)
        return ids, ends

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the marks as blanks and the dummy prefix still there."""
        if not ids or min(ids) > self.high:
            return "".join([self.texts[i] for i in ids])
        out = bytearray()
        for i in ids:
            if self.low <= i <= self.high:
                out.append(i - self.low)
            else:
                out += self.texts[i].encode()
        return out.decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the mark that it starts with.

        No piece has a line feed (or words are not cut there), so a word also ends
        before one; a word that starts with a line feed has no mark.
        """
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            words = [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
            if self.breaks_lines and "\n" in text:
                words = [x for w in words for x in w.replace("\n", " \n").split(" ")]
            return words
        if self.breaks_lines:
            text = text.replace("\n", " \n")
        return text.split(" ")

    def remember(self, texts: list[list[str]]) -> None:
        new: set[str] = set()
        for words in texts:
            new.update(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        listed = sorted(new)
        if not listed:
            return
        bare = "\n" if self.breaks_lines else "\0\0"
        ids, ends = self.encode_words([w if w.startswith(bare) else MARK + w for w in listed])
        ids, a, shown = ids.tolist(), 0, self.shown
        for w, z in zip(listed, ends.tolist(), strict=True):
            own = ids[a:z]
            self.known[w] = (" ".join([shown[i] for i in own]), self.decode(own))
            a = z

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.remember([words])
        return [int(i) for w in words for i in self.known[w][0].split()]


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(docs: DataFrame, model_file: str, ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with ids: ids, decoded too.

    Ids are those of the model's own encoder, then the end id. A null text counts
    as empty and has the end id only. Repeated rows give repeated rows, a null
    doc_id stays null, an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        end = str(enc.eos)
        for batch in batches:
            rows = []
            for part in chunks([t or "" for t in batch.column("text").to_pylist()]):
                texts = [enc.words(t) for t in part]
                enc.remember(texts)
                known = enc.known
                for words in texts:
                    found = [known[w] for w in words]
                    coded = " ".join([*(x[0] for x in found), end])
                    text = "".join(x[1] for x in found)[1:]
                    rows.append((coded.count(" ") + 1, sha256_hex(coded), sha256_hex(text), *((coded, text) if ids else ())))
            columns = [batch.column("doc_id"), *(pa.array(list(x)) for x in zip(*rows, strict=True))] if rows else []
            if rows:
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
