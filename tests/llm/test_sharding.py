from collections import Counter

import pytest

from spanlake.llm import sharding


def test_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(shards)
    assert len(table) == sharding.table_size(20) == 2003
    counts = Counter(table)
    assert len(counts) == 20 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.25 * 2003


def test_turns_by_hand():
    size, shards = 7, ["a", "b", "c"]
    table = sharding.lookup_table(shards, size)
    order = [[(sharding._number(f"offset|{s}") + k * (sharding._number(f"skip|{s}") % 6 + 1)) % 7 for k in range(7)] for s in shards]
    owner = {}
    for turn in range(7):
        owner[next(slot for slot in order[turn % 3] if slot not in owner)] = turn % 3
    assert table == [owner[i] for i in range(7)]


@pytest.mark.parametrize("bad", [([], None), (["a", "a"], None), (["a", "b", "c"], 2)])
def test_bad_parameters_raise(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(*bad)


def test_edge_cases(spark):
    rows = [(1, "x", "old"), (1, "x", "old"), (None, None, None), (2, "", "old"), (3, "z" * 100000, "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.with_shard(docs, ["a", "b", "c"])
    assert out.columns == ["doc_id", "text", "slot", "shard"]
    found = out.collect()
    assert len(found) == 5 and all(r.shard in "abc" for r in found)
    table = sharding.lookup_table(["a", "b", "c"])
    for r in found:
        slot = int(__import__("hashlib").md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % len(table)
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert sharding.with_shard(docs.where("false"), ["a"]).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(w in plan for w in ("Python", "Arrow", "Pandas"))
