"""Benchmark leaks against brute force, and the index's guarantee."""

import numpy as np

from gridwright.llm import decontamination as d
from gridwright.llm.queries import op7_decontamination


def test_finds_every_whole_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(x.doc_id, i.item_id) for x in docs for i in items if i.text in x.text}
    found = op7_decontamination(spark, sf).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in found}
    texts, bench = {x.doc_id: d.item_words([x.text.lower()])[0] for x in docs}, {i.item_id: d.item_words([i.text.lower()])[0] for i in items}
    for r in found:  # each is similar indeed
        a, b = set(d.shingle_hashes(texts[r.doc_id][r.first_word : r.end_word], 5).tolist()), set(d.shingle_hashes(bench[r.item_id], 5).tolist())
        assert len(a & b) >= 0.7 * len(b)


def test_edited_and_odd_texts(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew very strong coffee near an old mill by the slow river every misty winter morning"
    edited = item.replace("coffee", "tea")
    docs = [(1, f"before {item} after"), (2, f"Before, {edited.upper()}! after"), (3, "nothing of the kind here"), (4, None), (5, ""), (None, item), (1, item), (6, "w " * 100000 + item), (7, "tiny item"), (8, "a tiny item here"), (9, " ".join(item.split()[:12])), (10, "çA VA bien")]
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in docs], "doc_id long, text string, item_id int, low string")
    items = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "!?", 1), (13, "tiny item", 1), (14, "ÇA va BIEN", 1)], "item_id long, text string, doc_id int")
    found = d.find_leaks(df, items).collect()
    assert sorted(((r.doc_id or -1, r.item_id) for r in found)) == [(-1, 10), (1, 10), (1, 10), (2, 10), (6, 10), (7, 13), (8, 13), (10, 14)]
    first = next(r for r in found if r.doc_id == 6)
    assert (first.first_word, first.end_word, first.similarity) == (100000, 100000 + len(item.split()), 1.0)
    clean = d.without_leaks(df, items)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 9]
    assert d.find_leaks(df, items.limit(0)).collect() == [] and d.find_leaks(df.limit(0), items).collect() == []
    assert d.without_leaks(df, items.limit(0)).count() == len(docs)


def test_item_blocks_agree(spark, tiny, monkeypatch):
    key = lambda rows: sorted((r.doc_id, r.item_id) for r in rows)
    whole = key(op7_decontamination(spark, tiny).collect())
    monkeypatch.setattr(d, "ITEM_BLOCK", 7)
    assert key(op7_decontamination(spark, tiny).collect()) == whole


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = d.ItemIndex(list(range(50)), [" ".join(f"w{rng.integers(10**6)}" for _ in range(20)) for _ in range(50)])
    prints = index.prints[rng.integers(50, size=400)].copy()
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    w, i = index.within(prints)
    dist = np.bitwise_count(prints[:, None] ^ index.prints[None])
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(dist <= d.RADIUS))))


def every_window(index, words, i):
    """(similarity, first start) of the best of all item-sized windows."""
    size, want, best = int(index.length[i]), set(index.shingles[i].tolist()), (0.0, 0)
    for a in range(max(0, len(words) - size) + 1):
        mine = np.unique(d.shingle_hashes(words[a : a + size], min(d.K, size)))
        both = np.array([h for h in mine.tolist() if h in want], dtype=np.uint64)
        best = max(best, (float(index.weigh(both).sum() / max(index.weigh(mine).sum(), index.weight[i])), -a))
    return best


def test_near_the_threshold_against_every_window():
    rng = np.random.default_rng(5)
    some = lambda n, of=10**6: [f"w{x}" for x in rng.integers(of, size=n)]
    common = some(12)
    bench = [common + some(18) if i % 2 else some(int(rng.integers(3, 90))) for i in range(60)]
    index = d.ItemIndex(list(range(60)), [" ".join(b) for b in bench])
    near = 0
    for trial in range(600):
        x = list(bench[trial % 60])
        for _ in range(rng.integers(1, 4)):
            at = int(rng.integers(len(x)))
            x[at : at + int(rng.integers(0, 2))] = some(int(rng.integers(0, 3)))
        words = d.item_words([" ".join(some(int(rng.integers(0, 30))) + x + x[: trial % 3] + some(int(rng.integers(0, 30))))])[0]
        want = every_window(index, words, trial % 60)
        near += 0.8 <= want[0] <= 0.9
        found = [(s, -a) for i, a, _, s in index.leaks(words) if i == trial % 60]
        assert found == ([want] if want[0] >= d.SIMILARITY else [])
    assert near > 60


def test_none_is_lost_at_the_threshold():
    """40 words, three in a row of them replaced: 29 of 36 shingles are left."""
    rng = np.random.default_rng(8)
    bench = [[f"w{x}" for x in rng.integers(10**6, size=40)] for _ in range(400)]
    index = d.ItemIndex(list(range(400)), [" ".join(b) for b in bench])
    for i, b in enumerate(bench):
        at = int(rng.integers(8, 30))
        words = d.item_words([" ".join(["before", *b[:at], "x", f"y{i}", "z", *b[at + 3 :], "after"])])[0]
        assert [(r[0], r[1], r[2]) for r in index.leaks(words)] == [(i, 1, 41)]


def test_weights_are_those_of_all_items(spark, monkeypatch):
    """Items with a beginning in common: it weighs the same whatever block they are in, as do shingles of other blocks' items."""
    head = "choose the best answer to the question below and explain it in one short sentence"
    own = [" ".join(f"n{i}x{j}" for j in range(12)) for i in range(20)]
    items = spark.createDataFrame([(i, f"{head} {t}") for i, t in enumerate(own)], "item_id long, text string")
    tail = " ".join(head.split()[-5:])
    docs = spark.createDataFrame([(i, f"{tail} {t}" if i % 2 else t) for i, t in enumerate(own)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, d.find_leaks(docs, items).collect()))
    whole, clean = rows(), sorted(r.doc_id for r in d.without_leaks(docs, items).collect())
    assert [(r[0], r[1]) for r in whole] == [(i, i) for i in range(1, 20, 2)] and clean == list(range(0, 20, 2))
    monkeypatch.setattr(d, "ITEM_BLOCK", 7)
    assert rows() == whole
    assert sorted(r.doc_id for r in d.without_leaks(docs, items).collect()) == clean


def test_fingerprints_propose_nine_in_ten_of_edited_passages():
    """One to three words in a row of 40 replaced, beside texts of other words: what the named method finds before the exact bound."""
    rng = np.random.default_rng(11)
    bench = [[f"w{x}" for x in rng.integers(10**6, size=40)] for _ in range(300)]
    index = d.ItemIndex(list(range(300)), [" ".join(b) for b in bench])
    leaky = found = 0
    for i, b in enumerate(bench):
        x = list(b)
        at = int(rng.integers(6, 30))
        x[at : at + 1 + i % 3] = [f"e{j}" for j in range(1 + i % 3)]
        words = d.item_words([" ".join([*(f"a{j}" for j in range(i % 90)), *x, *(f"z{j}" for j in range(50))])])[0]
        h = d.shingle_hashes(words, d.K)
        mine = index.proposed(h, len(words), d.K, [i], np.flatnonzero(np.isin(h, index.known)))
        want = {r[0]: (r[3], -r[1]) for r in index.leaks(words)}
        leaky, found = leaky + len(want), found + len(mine)
        assert set(mine) <= set(want) and all(index.leaks(words, one=True)[0][0] == j for j in want)
    assert leaky == 300 and found >= 0.9 * leaky
