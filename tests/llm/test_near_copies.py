"""The n-gram Jaccard join, its trie and its signatures against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm.components import components
from gridwright.llm import ngram_join
from gridwright.llm.ngram_join import Bits, least, ngram_jaccard_components, prefix, without_near_copies
from gridwright.llm.queries import op5_ngram_jaccard_join
from gridwright.llm.shingles import shingle_sets
from gridwright.llm.trie import PrefixTrie


def sets(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, similarity):
    s, least = sets(rows, k), Fraction(similarity)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) >= least * max(len(s[i]), len(s[j])):
                both = len(s[i] & s[j])
                if both >= least * (len(s[i]) + len(s[j]) - both):
                    up[find(i)] = find(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        known = least_id.get(find(i))
        least_id[find(i)] = d if known is None else known if d is None else min(d, known)
    return sorted((repr((d, len(s[i]), least_id[find(i)])) for i, (d, _) in enumerate(rows)))


def got(df):
    return sorted(repr((r[0], r[1], r[2])) for r in df.collect())


def family(rng, n, words, edits, first):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_matches_brute_force_on_near_copies(spark):
    rng = random.Random(11)
    rows = family(rng, 300, 120, 4, 1000) + family(rng, 60, 14, 1, 5000) + family(rng, 40, 60, 8, 7000)
    rows += [(i, rows[0][1]) for i in range(100)] + [(i, "A b\tc") for i in range(200, 204)] + [(210, "a B c d"), (211, "a"), (212, "A"), (213, "a b")]
    rows += [(300, None), (301, ""), (302, " \n"), (None, rows[0][1]), (None, "lonely words only here"), (303, "x " * 60000), (304, "x " * 60001), (1000, rows[5][1]), (1000, rows[5][1])]
    df = spark.createDataFrame([(i, t, i, "n") for i, t in rows], "doc_id long, text string, component_id long, node string")
    for k, similarity in ((3, "0.9"), (5, "0.8")):
        assert got(ngram_jaccard_components(df, k=k, similarity=similarity)) == brute(rows, k, similarity)
    assert ngram_jaccard_components(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert got(op5_ngram_jaccard_join(spark, tiny)) == brute(rows, 3, "0.9")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=25), min_size=1, max_size=25), st.sets(st.integers(0, 40), min_size=1, max_size=25), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_trie_finds_what_brute_force_finds(stored, probe, ratio):
    num, den = ratio
    trie = PrefixTrie([np.array(sorted(s), dtype=np.uint64) for s in stored])
    want = sorted((i, len(s & probe)) for i, s in enumerate(stored) if s and den * len(s & probe) >= num * len(s | probe))
    assert sorted(trie.probe(np.array(sorted(probe), dtype=np.uint64), num, den)) == want


def test_similar_sets_share_enough_tokens():
    rng = random.Random(1)
    for num, den in ((9, 10), (4, 5), (1, 2), (1, 5)):
        for _ in range(600):
            n = rng.choice([1, 2, 4, 5, 9, 10, 11, 20, 60, 200, 900])
            x = {rng.getrandbits(63) for _ in range(n)}
            y = set(x)
            while True:
                nxt = (y | {rng.getrandbits(63)}) if rng.random() < 0.5 else (y - {rng.choice(sorted(y))})
                if not nxt or den * len(x & nxt) < num * len(x | nxt):
                    break
                y = nxt
            a, b = (sorted(s)[: prefix(len(s), num, den)] for s in (x, y))
            assert len({*a} & {*b}) >= max(least(len(s), num, den) for s in (x, y)), (n, len(x ^ y))


def test_shingles_of_odd_texts():
    out = [len(s) for s in shingle_sets(pa.array(["a b c d", "", None, "A  b\tC\nd e", "one", "ONE", "a b c a b c", "a\x1cb c", "a b"]), 3)]
    assert out == [2, 0, 0, 3, 1, 1, 3, 1, 1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (7, 300), (500, 501)]
    rows = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {rows[i] for i in range(41)} == {0} and rows[300] == 0 and rows[101] == 100 and rows[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_that_share_half_a_key_stay_apart(spark):
    """Where several sets share the first half of their keys, both halves tell them apart."""
    keys = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "a long, b long")
    nodes = [r[0] for r in keys.select(ngram_join._node(keys)).collect()]
    assert len(set(nodes)) == 3 and nodes[2] == 2 and 1 not in nodes
    assert [r[0] for r in keys.where("a = 2").select(ngram_join._node(keys.where("a = 2"))).collect()] == [2]


def test_bits_have_all_their_keys(spark):
    rng = random.Random(8)
    for n in (0, 1, 5000):
        keys = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        bits = Bits(spark.createDataFrame([(k,) for k in keys], "key long"))
        has = bits.test()
        assert bits.empty == (n == 0) and has(np.array(keys, dtype=np.int64)).all()
        assert has(np.array([rng.getrandbits(64) - (1 << 63) for _ in range(4000)], dtype=np.int64)).mean() < 0.2


def test_one_row_of_each_component(spark):
    rng = random.Random(5)
    rows = family(rng, 80, 100, 3, 0) + [(i, f"lonely text number {i} " * 8) for i in range(200, 230)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[0][1]), (None, rows[0][1]), (500, ""), (500, ""), (501, None)]
    df = spark.createDataFrame([(t, i, k) for k, (i, t) in enumerate(rows)], "`my.text` string, `my.id` long, h long")
    got = without_near_copies(df, "my.id", "my.text")
    assert got.columns == ["my.text", "my.id", "h"]
    left = [(r[1], r[0]) for r in got.collect()]
    kept = [eval(x) for x in brute(rows, 5, "0.8")]
    want = sorted({i for i, n, c in kept if n and i is not None and i == c})
    assert sorted(i for i, t in left if i is not None and (t or "").strip()) == want
    assert sum(i is None for i, _ in left) == 2 and sum(i == 500 for i, _ in left) == 2 and sum(i == 501 for i, _ in left) == 1
    assert without_near_copies(df.limit(0), "my.id", "my.text").collect() == []
