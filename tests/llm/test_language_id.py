import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import language


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.identified(docs, language.fit(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(found):
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def scores(entries):
    return language.Scores({k: i for i, k in enumerate(entries)}, np.array(list(entries.values()) or np.zeros((0, 2)), np.float32))


def test_backoff():
    grams = {" unk": [-2.0, -1.0], "zz": [-8.0, -2.0], "q": [-3.0, -4.0]}
    model = language.Model(["x", "y"], scores({"known": [-1.0, -9.0]}), {n: scores({k: v for k, v in grams.items() if len(k) == n}) for n in language.LENGTHS})
    assert model.score("known").tolist() == [-1, -9]
    assert model.score("unknown").tolist() == [-2, -1]  # its one known 4-gram
    assert model.score("azza").tolist() == [-8, -2]  # no known 4- or 3-gram
    assert model.score("q").tolist() == [-3, -4]
    assert model.score("v").tolist() == [0, 0]
    assert model.predict(["known q", "", None, "123 !", "½ ²", "KNOWN"])[1:5] == [("und", 0.0)] * 4
    assert [x for x, _ in model.predict(["known q", "Known unknown unknown", "v"])] == ["x", "x", "x"]


def brute_force(rows, sample=None):
    """(doc_id, lang, score) of every row by the definition: dictionaries, one word at a time."""
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    fitted = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and i is not None and not out(i)]
    by_word = Counter((w, lang) for t, lang in fitted for w in split(t))
    languages = sorted({lang for _, lang in by_word})
    by_gram = {n: Counter() for n in language.LENGTHS}
    for (w, lang), c in by_word.items():
        for n, counts in by_gram.items():
            s = f" {w} " if n > 1 else w
            for k in range(len(s) - n + 1):
                counts[s[k : k + n], lang] += c

    def logs(counts):
        total = {x: sum(c for (_, lang), c in counts.items() if lang == x) for x in languages}
        names = {k for k, _ in counts}
        return {k: [math.log(counts[k, x] + 0.5) - math.log(total[x] + 0.5 * (len(names) + 1)) for x in languages] for k in names}

    words, grams = logs(by_word), {n: logs(c) for n, c in by_gram.items()}

    def value(w):
        if w in words:
            return words[w]
        for n in language.LENGTHS:
            s = f" {w} " if n > 1 else w
            known = [grams[n][s[k : k + n]] for k in range(len(s) - n + 1) if s[k : k + n] in grams[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(languages)

    result = []
    for i, t, _ in rows:
        found = split(t)
        if not languages or not found or not any(c.isalpha() for c in t):
            result.append((i, "und", 0.0))
            continue
        mean = [sum(x) / len(found) for x in zip(*map(value, found))]
        best = max(mean)
        result.append((i, languages[mean.index(best)], 1 / sum(math.exp(x - best) for x in mean)))
    return result


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_against_brute_force(table, edge, documents, monkeypatch):
    docs = edge if table == "edge" else documents
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = sorted(brute_force(rows), key=repr)
    for chunk, remembered in ((10**6, 250_000), (700, 50)):
        monkeypatch.setattr(language, "CHUNK", chunk)
        monkeypatch.setattr(language, "REMEMBERED", remembered)
        model = language.fit(docs)
        got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identified(docs, model).collect()]
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=repr), want):
            assert a[0] == b[0] and a[2] == pytest.approx(b[2], rel=1e-4) and (a[1] == b[1] or b[2] < 0.51), (a, b)


def test_edge_rows(edge, nothing):
    model = language.fit(edge)
    rows = language.identified(edge, model).collect()
    texts = {(r["doc_id"], r["text"]) for r in edge.collect()}
    assert len(rows) == edge.count()
    letterless = {i for i, t in texts if not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == letterless
    assert language.identified(nothing, model).collect() == [] and language.fit(nothing).languages == []
    assert {r["lang_pred"] for r in language.identified(edge, language.fit(nothing)).collect()} == {"und"}


def test_no_labels_beyond_the_fit(spark):
    """Predictions do not read lang, and held-out labels change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~language.held_out(F.col("doc_id")), F.col("lang")))
    a, b = language.fit(docs), language.fit(hidden)
    assert a.words.place.keys() == b.words.place.keys() and all((a.score(w) == b.score(w)).all() for w in a.words.place)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    assert sorted(language.identified(other, a).collect()) == sorted(language.identified(docs, a).collect())


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample_rows=100)
    assert set(model.languages) == {r[0] for r in docs.select("lang").distinct().collect()} - {None}
    rows = [r for r in language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_a_language_of_few_rows_is_learned(spark):
    """One language holds nearly all rows; each has the same share of the sample, and no word is cut."""
    rows = [(i, f"the house number{i % 7} is on the hill", "en") for i in range(3000)] + [(5000 + i, f"das haus nummer{i} steht im tal", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample_rows=200)
    assert model.languages == ["de", "en"] and {f"nummer"} <= {w for w in model.words.place if w == "nummer"}
    got = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred != lang").count()
    assert got == 0


def test_accepted_rows_keep_all_columns(edge, nothing):
    with_letters = [r for r in edge.collect() if any(c.isalpha() for c in r["text"] or "")]
    kept = language.accepted(edge, language.fit(nothing))
    assert kept.columns == edge.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, with_letters))
    # A text whose words and n-grams are all unknown has no language among several.
    model = language.fit(edge)
    assert len(model.languages) == 2
    told = {r["doc_id"]: r["score"] for r in language.identified(edge, model).collect()}
    kept = {r["doc_id"] for r in language.accepted(edge, model).collect()}
    assert {r["doc_id"] for r in with_letters} - kept == {i for i in {r["doc_id"] for r in with_letters} if told[i] <= 0.5 * (1 + 1e-6)}


def test_no_string_an_entry_on_the_driver():
    n = 100_000
    rows = pa.table({"entry": pa.array([f"entry number {i}" for i in range(n)]), "lang": pa.array(["x", "y"] * (n // 2)), "n": pa.array(np.ones(n, np.int64))})
    with open("/dev/null", "wb") as nowhere:
        tracemalloc.start()
        found = language.Scores.of(rows, ["x", "y"])
        pickle.dump(found, nowhere, 5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 100 * n  # bytes: the counts and logs of two languages take 16 an entry each
    sent = pickle.loads(pickle.dumps(pickle.loads(pickle.dumps(found))))
    assert sent.place == {f"entry number {i}": i for i in range(n)} and (sent.logs == found.logs).all()
