"""Sharding and mixing against brute force and their stated laws."""

import bisect
import itertools
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridwright.llm import mixing, sharding
from gridwright.llm.queries import op3_sharding, op4_mixing


def brute_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    c = max(max(sizes), -(-sum(sizes) // shards))
    while not fits(c):
        c += 1
    return c


def test_capacity_is_the_smallest(spark, monkeypatch):
    rng = random.Random(3)
    for case in range(4):
        monkeypatch.setattr(sharding, "BINS", [8, 16, 64, 1 << 16][case])
        sizes = [rng.randint(1, [5, 400, 90, 1000][case]) for _ in range([40, 300, 500, 60][case])]
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        shards = [3, 7, 24, 50][case]
        cap, cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "end long"), at, shards)
        assert cap == brute_capacity(sizes, shards)
        edges = [0, *cuts, at]
        assert max(b - a for a, b in zip(edges, edges[1:])) == cap and all(b >= a for a, b in zip(edges, edges[1:]))


def test_capacity_of_many_groups(spark, monkeypatch):
    rng, shards = random.Random(8), 24
    for bins in (1 << 16, 1 << 11):
        monkeypatch.setattr(sharding, "BINS", bins)
        sizes = [rng.choice([rng.randint(20, 400), rng.randint(1000, 20000)]) for _ in range(20000)]
        ends = list(itertools.accumulate(sizes))
        cap, cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], shards)

        def fits(c):
            at = 0
            for _ in range(shards):
                at = ends[bisect.bisect_right(ends, at + c) - 1] if at + c >= ends[0] else at
            return at == ends[-1]

        assert fits(cap) and not fits(cap - 1)
        edges = [0, *cuts, ends[-1]]
        assert max(b - a for a, b in zip(edges, edges[1:])) <= cap and all(b >= a for a, b in zip(edges, edges[1:])) and set(cuts) <= set(ends)


def check_shards(rows, shards):
    slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        text = (r.text or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        groups[r.text].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in groups.values())
    return sizes


def test_shards(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sizes = check_shards(sharding.shard(docs, 6).collect(), 6)
    largest = max(Counter({r.text: r.n * (len(r.text.encode()) + 8) for r in docs.groupBy("text").agg(F.count("*").alias("n")).collect()}).values())
    assert max(sizes.values()) <= sum(sizes.values()) / 6 + largest and min(sizes.values()) >= sum(sizes.values()) / 6 - 2 * largest
    out = op3_sharding(spark, tiny)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() == docs.count()


def test_odd_shards(spark):
    data = [(i, "hot", "c") for i in range(400)] + [(None, None, "n")] * 3 + [(7, "", "e"), (8, "é" * 9, None), (9, "x" * 300000, "l")] + [(i, f"text {i}", "t") for i in range(50)]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string").withColumn("_key", F.lit(1))
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(data)
    sizes = check_shards(rows, 4)
    assert set(sizes) == {0, 1, 2, 3}
    assert sharding.shard(docs.limit(0), 4).collect() == []
    assert {r.slot for r in sharding.shard(docs.limit(1), 4).collect()} == {0}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)], "doc_id long, text string")
    sharding.write_shards(sharding.shard(docs, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 3


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.targets([100, 1, 0], [1, 2, 3]) == [98.0, 3.0, 0.0]
    assert mixing.targets([], []) == []


def test_mix(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = op4_mixing(spark, tiny).collect()
    want = {r.doc_id: (r.source, len(r.text.encode().split())) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == {k: v[1] for k, v in want.items()}
    taken, sizes, goal = Counter(), Counter(), {}
    for r in rows:
        s = want[r.doc_id][0]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        sizes[s] += r["size"]
        goal[s] = (r.target, r.source_size)
    names = sorted(sizes)
    targets = mixing.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, targets):
        assert goal[s] == (t, sizes[s]) and abs(taken[s] - t) <= 1
    assert sorted(op4_mixing(spark, tiny).collect()) == sorted(rows)


def test_odd_mix(spark):
    data = [(1, "a b c", None), (1, "a b c", None), (None, "x " * 500, "s"), (3, None, "s"), (4, " \t", "empty"), (5, "one", "é")] + [(i, "w " * 20, "hot") for i in range(10, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit(3)).withColumn("rid", F.lit("x"))
    mix = mixing.Mix(docs)
    rows = mix.rows.collect()
    assert len(rows) == len(data) and all(r.taken <= 3 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal) <= 1 for s, _, goal, _ in mix.plan) and [p[0] for p in mix.plan] == ["empty", "hot", "s", "é", None]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("source = 'empty'").count() == 1
    pieces = mix.pieces.collect()
    assert all(p.end_word > p.first_word for p in pieces) and sum(p.end_word - p.first_word for p in pieces) == sum(taken.values())
    assert mixing.Mix(docs.limit(0)).rows.collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []


def test_query_shards_are_the_smallest_possible(spark, tiny):
    """The largest shard of the query's own result against the least capacity of its groups in their order, by brute force."""
    from gridwright.llm.queries import op3_sharding

    rows = op3_sharding(spark, tiny).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    shards = [[r for r in rows if r.shard == s] for s in range(24)]
    bytes_ = [sum(r.size for r in rows_) for rows_ in shards]
    groups = {}
    for s, rows_ in enumerate(shards):
        for r in sorted(rows_, key=lambda r: r.slot):
            groups.setdefault((s, texts[r.doc_id]), []).append(r.size)
    alone = [s for s in range(24) if len({texts[r.doc_id] for r in shards[s]}) == 1]
    sizes = [sum(v) for (s, _), v in groups.items() if s not in alone]
    assert len({t for _, t in groups}) == len(groups)
    assert max(b for s, b in enumerate(bytes_) if s not in alone) == brute_capacity(sizes, 24 - len(alone))


def test_query_mix_against_a_plain_schedule(spark, tiny):
    """Words taken of each document, by walking the schedule slot by slot over the shuffled streams."""
    mix = mixing.Mix(spark.read.parquet(f"{tiny}/documents.parquet"))
    rows, pieces = mix.rows.collect(), mix.pieces.collect()
    streams = {}
    for p in pieces:
        streams.setdefault((p.s, p.slot), []).append((p.end_word - p.first_word, p.epoch))
    slots, golden = sum(x[3] for x in mix.plan), 0.6180339887498949
    ends = [sum(x[3] for x in mix.plan[: i + 1]) / slots for i in range(len(mix.plan))]
    rank, want = {}, {}
    for k in range(slots):
        u = k * golden % 1.0
        s = min(sum(u >= e for e in ends[:-1]), len(ends) - 1)
        n = rank[s] = rank.get(s, -1) + 1
        if n < mix.plan[s][3]:
            want[(s, k)] = n
    missing = {s: x[3] - 1 - rank.get(s, -1) for s, x in enumerate(mix.plan) if x[3] - 1 > rank.get(s, -1)}
    got = set(streams)
    assert set(want) <= got and len(got) == len(want) + sum(missing.values())
    for (s, _), parts in streams.items():
        assert sum(n for n, _ in parts) <= mix.block and len({e for _, e in parts}) == 1
    for s, (source, size, goal, _) in enumerate(mix.plan):
        mine = [r for r in rows if r.source == source]
        assert sum(r.taken for r in mine) == min(round(goal), int(3 * size)) and max((r.taken / r.size for r in mine if r.size), default=0) <= 3
        epochs = {e for (z, _), parts in streams.items() if z == s for _, e in parts}
        assert epochs == set(range(len(epochs)))
