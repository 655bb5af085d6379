"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word is
scored by its character n-grams, from the longest down: the first length of which
some n-gram is known gives the mean of those n-grams' log frequencies. A document
gets the language with the greatest sum over its words.

The model is fitted on a sample of labelled rows whose expected size is bounded
(SAMPLE_ROWS), the same bound for each language, and holds all words and n-grams
of these rows. Prediction reads every row's whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import ship, written

UNKNOWN = "und"
#: Bound on the labelled rows that the model is fitted on (expected number).
SAMPLE_ROWS = 20_000
#: Lengths of n-grams, in the order of backoff.
LENGTHS = (4, 3, 2, 1)
#: Words whose values a worker remembers.
REMEMBERED = 200_000
#: Characters whose words are held at once.
CHUNK = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")


def pieces_of(text: str) -> Iterator[str]:
    """Parts of about CHUNK characters that end between words."""
    at = 0
    while len(text) - at > CHUNK:
        inside = _LETTERS.match(text, at + CHUNK)
        end = inside.end() if inside else at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(text: str) -> list[str]:
    """The words of a text, for the fit and for predictions alike."""
    return _LETTERS.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    """n-grams of a word between blanks (without the blanks for single characters)."""
    s = f" {word} " if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _ngrams(word: Column, n: int) -> Column:
    """The same of a column of words."""
    s = F.concat(F.lit(" "), word, F.lit(" ")) if n > 1 else word
    places = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1))
    return F.transform(places, lambda i: F.substring(s, i, F.lit(n)))


def held_out(doc_id: Column) -> Column:
    """Whether the row stays out of the fit: CRC-32 of the doc_id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scores:
    """Log frequencies of entries (words, or n-grams of one length), a row each and a column for each language.

    The entries are one Arrow buffer, on the driver and when sent. The dict of their
    places is made where one is looked up or a worker gets them, which keeps it alone.
    """

    def __init__(self, entries: Iterable[str] | pa.Array, logs: np.ndarray):
        self.entries = entries if isinstance(entries, pa.Array) else pa.array(list(entries), pa.string())
        self.logs = logs

    @cached_property
    def place(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.entries.to_pylist())}

    def __getstate__(self) -> dict:
        return {"entries": pa.array(list(self.place), pa.string()) if "place" in vars(self) else self.entries, "logs": self.logs}

    def __setstate__(self, state: dict) -> None:
        self.place = {x: i for i, x in enumerate(state["entries"].to_pylist())}
        self.logs = state["logs"]

    @classmethod
    def of(cls, entries: pa.Table, languages: list[str]) -> Scores:
        """From rows (entry, lang, n); half an occurrence is added everywhere."""
        names = entries.column("entry").combine_chunks().dictionary_encode()
        langs = entries.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        counts = np.zeros((len(names.dictionary), len(languages)))
        counts[names.indices.to_numpy(), lang] = entries.column("n").to_numpy()
        logs = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * (len(counts) + 1))
        return cls(names.dictionary, logs.astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    words: Scores
    grams: dict[int, Scores]
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def score(self, word: str) -> np.ndarray:
        """The word's value for each language: by itself, else by its longest known n-grams."""
        if (i := self.words.place.get(word)) is not None:
            return self.words.logs[i]
        for n in LENGTHS:
            scores = self.grams[n]
            found = [i for g in ngrams(word, n) if (i := scores.place.get(g)) is not None]
            if found:
                return scores.logs[found].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.languages))

    def _remember(self, texts: list[list[str]]) -> None:
        new: set[str] = set()
        for words in texts:
            new.update(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED or self.table is None:
            self.known, new = {}, set().union(*texts)
            self.table = np.zeros((max(REMEMBERED, len(new)), len(self.languages)), np.float32)
        for i, w in enumerate(sorted(new), len(self.known)):
            self.known[w] = i
            self.table[i] = self.score(w)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. The score is the softmax of the mean over words: 1 is certain."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        batch: list[tuple[int, list[str]]] = []
        size = 0

        def add() -> None:
            self._remember([words for _, words in batch])
            for i, words in batch:
                sums[i] += self.table[[self.known[w] for w in words]].sum(axis=0, dtype=np.float64)
                counts[i] += len(words)

        for i, text in enumerate(texts):
            for piece in pieces_of(text or ""):
                batch.append((i, words_of(piece)))
                size += len(piece)
                if size > CHUNK:
                    add()
                    batch, size = [], 0
        add()
        out = []
        for text, total, n in zip(texts, sums, counts.tolist(), strict=True):
            if not n or not self.languages or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            mean = total / n
            best = int(mean.argmax())
            out.append((self.languages[best], float(1 / np.exp(mean - mean[best]).sum())))
        return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows with text and lang that are not held out.

    Each language gives at most its share of sample_rows (in expectation): all of
    its rows, or else some of them, chosen by a hash of doc_id and text.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows_of = {r[0]: r[1] for r in labelled.groupBy(F.col("lang").cast("string")).count().collect()}  # one row a language
    parts = 1 << 30
    limits = [(lang, min(parts, parts * sample_rows // (len(rows_of) * n))) for lang, n in rows_of.items()]
    share = F.broadcast(spark.createDataFrame(limits, "share_lang string, share_limit long"))  # one row a language
    sample = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("place"))
    sample = sample.join(share, F.col("lang") == F.col("share_lang")).where("place < share_limit").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for piece in pieces_of(text.as_py()):
                    found.update((lang, w) for w in words_of(piece))
                    if len(found) > REMEMBERED:
                        yield rows()
                        found.clear()
        yield rows()

    words = written(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # What comes to the driver is bounded by the sample.
    entries = words.select(F.col("word").alias("entry"), "lang", "n").toArrow()
    languages = sorted(entries.column("lang").unique().to_pylist())
    found, grams = Scores.of(entries, languages), {}
    del entries
    for n in LENGTHS:
        cut = words.select("lang", "n", F.explode(_ngrams(F.col("word"), n)).alias("entry"))
        grams[n] = Scores.of(cut.groupBy("entry", "lang").agg(F.sum("n").alias("n")).toArrow(), languages)
    pa.default_memory_pool().release_unused()
    return Model(languages, found, grams)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is UNKNOWN with score 0 where the text is null or has no letter, and
    everywhere if there was nothing to fit. Ties go to the first language in order.
    A null doc_id stays null and is not held out. Repeated rows give repeated rows,
    an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(Model(model.languages, model.words, model.grams))  # bounded by SAMPLE_ROWS
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, part, size = batch.column("text"), [], [], 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > CHUNK:
                    found += sent.value.predict(part)
                    part, size = [], 0
            found += sent.value.predict(part)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language.

    Rejected are texts that are null or have no letter, and, where there are several
    languages, those of which no word or n-gram tells one from another: the score is
    that of chance. Where nothing was learned, all texts with a letter stay.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.words, model.grams))  # bounded by SAMPLE_ROWS
    chance = 1 / len(model.languages) * (1 + 1e-6) if len(model.languages) > 1 else 0.0
    learned = bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                if learned:
                    good = [lang != UNKNOWN and score > chance for lang, score in sent.value.predict(texts)]
                else:
                    good = [any(map(str.isalpha, t or "")) for t in texts]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
