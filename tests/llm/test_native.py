"""Chat formatting, exact dedup and sharding: SQL, small cases, and plans without Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import pairs
from comparing import rows_of, sql_rows
from pyspark.sql import functions as F

from quadrille.llm import chat, common, exact_dedup, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_exact_dedup", "op6_sharding"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


PARTS = [*chat.CONTROLS, "\\", "\n", "<", "[", "s>", "INST]", "é", " ok ", "[\\INST]", "<\\/s>", "0", "2"]


def test_chats_come_back(spark):
    rng = random.Random(1)
    text = lambda: rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))])
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["user", "assistant", "system", "tool", None, "", "a\nb", "x\\\n", "[INST]0"]), text()) for c in range(120) for _ in range(5)]
    rows += [(None, 1, "user", "null id"), (500, 1, "user", "twice"), (500, 1, "user", "twice"), (501, 0, "user", "long " * 50_000)]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, line string, chat string, source string")
    want = defaultdict(list)
    for c, n, role, t in rows:
        want[c].append((n is not None, n or 0, role or "", t or ""))
    got = chat.format_chats(table).withColumn("level_free", F.size(chat.split_turns(F.col("chat")))).collect()
    assert len(got) == len(want)
    for r in got:
        source = [(role, t) for _, _, role, t in sorted(want[r["conv_id"]])]
        assert [(x["role"], x["text"]) for x in r["turns"]] == source and r["identical"]
        for body in re.findall(r"(?s)(?:\[INST\]|<s>|<<SYS>>)\d(.*?)(?:\[/INST\]|</s>|<</SYS>>)", r["chat"]):
            assert not any(c in body for c in chat.CONTROLS)
    digests = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(table)).collect()}
    for c, turns in want.items():
        loss = "".join(t for _, _, role, t in sorted(turns) if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, _, role, t in sorted(turns))
        assert digests[c]["loss_chars"] == len(loss) and digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and digests[c]["n_turns"] == len(turns)
    assert chat.format_chats(table.limit(0)).collect() == []


def exact_model(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), -(2**63) if i is None else i))
    out = []
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        keep = min(g)[1]
        own = -(2**63) if i is None else i
        out.append((i, None if keep == -(2**63) else keep, len(g), own == keep))
    return sorted(out, key=repr)


WEAK = {
    "sha256": exact_dedup.sha256,
    "length": lambda norm: F.length(norm).cast("string").cast("binary"),
    "constant": lambda norm: F.lit(b"x"),
}


@pytest.mark.parametrize("digest", sorted(WEAK))
def test_exact_groups(edge, nothing, digest):
    """Weak digests collide, and the byte verification has to part the texts."""
    got = exact_dedup.exact_groups(edge, WEAK[digest]).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == exact_model(pairs())
    assert exact_dedup.exact_groups(nothing, WEAK[digest]).collect() == []


def test_lookup_in_runs(spark, edge, tmp_path):
    path = f"file://{tmp_path}/runs"
    ids = common.ids_of(edge)
    exact_dedup.flush_runs(edge, ids, path)
    exact_dedup.flush_runs(edge.where("doc_id = 8"), ids, path)
    found = exact_dedup.lookup(spark, path, hashlib.sha256(b"word").digest())
    assert sorted(r["doc_id"] for r in found.collect()) == [8, 8, 9]


def test_filters_part_single_digests_from_the_rest(spark, edge, tmp_path):
    path = f"file://{tmp_path}/runs"
    exact_dedup.flush_runs(edge, common.ids_of(edge), path)
    runs = exact_dedup.open_runs(spark, path)
    assert runs.select("run").distinct().count() > 1
    times = Counter(bytes(r["digest"]) for r in runs.collect())
    found = exact_dedup.probed(runs).collect()
    assert len(found) == sum(times.values())
    assert all(r["maybe"] == (times[bytes(r["digest"])] > 1) for r in found)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_runs_merge_level_by_level(spark, monkeypatch, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    rng = random.Random(fan)
    rows = [(bytes([rng.randrange(6)]), i, rng.randrange(4), rng.randrange(11)) for i in range(200)]
    runs = spark.createDataFrame(rows, "digest binary, doc_id long, size long, run long")
    want = {d: (min((-s, i) for x, i, s, _ in rows if x == d)[1], sum(x == d for x, *_ in rows)) for d in {r[0] for r in rows}}
    level = runs.select("run", "digest", "doc_id", "size", F.lit(1).cast("long").alias("entries"))
    one = exact_dedup.merged(level).collect()
    assert Counter((r["run"], bytes(r["digest"])) for r in one) == Counter({(run // fan, d): 1 for d, _, _, run in rows})
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.compacted(runs).collect()} == want


def shard_model(rows, limit):
    """Split one bit at a time, as extendible hashing does."""
    bits = lambda i: int(hashlib.sha256(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    out, todo = {}, [(0, 1, [(i, len((t or "").encode()), bits(i)) for i, t in rows])]
    while todo:
        depth, shard, own = todo.pop()
        if not own:
            continue
        if sum(n for _, n, _ in own) > limit and depth < 60:
            for b in (0, 1):
                todo.append((depth + 1, shard * 2 + b, [x for x in own if x[2] >> (59 - depth) & 1 == b]))
        else:
            for i, _, _ in own:
                out[i] = (depth, shard)
    return out


@pytest.mark.parametrize("limit", [300, 5000, 10**9])
def test_shards(edge, nothing, limit):
    want = shard_model(pairs(), limit)
    got = sharding.sharded(edge, limit).collect()
    assert len(got) == len(pairs())
    files = defaultdict(list)
    for r in got:
        assert (r["depth"], r["shard"]) == want[r["doc_id"]]
        files[r["shard"], r["page"]].append(r)
    for own in files.values():
        size = sum(r["n_bytes"] for r in own)
        assert {(r["shard_docs"], r["shard_bytes"]) for r in own} == {(len(own), size)}
        assert size <= limit or len(own) == 1
    assert sharding.sharded(nothing, limit).collect() == []


def test_a_hot_key_goes_to_pages(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = sharding.sharded(rows, 1000).groupBy("shard", "page").agg(F.sum("n_bytes").alias("n")).collect()
    assert {r["shard"] for r in got} == {got[0]["shard"]} and all(r["n"] <= 1000 for r in got)
    assert len(got) < 4 * 3000 * 9 / 1000
