"""Whitening, language-model scores and the divergence audit against brute force, SQL and edge cases."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridwright.llm import divergence, lm, queries, recurrent, whitening

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def texts(tiny):
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


# Whitening


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    v = np.cov(u.T, bias=True)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:4], w[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ w / np.sqrt(e), e / np.trace(v)


def test_op11_equals_brute_force(spark, tiny):
    raw = spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, dev, w, explained = brute_whitening(list(raw.embedding))
    got = queries.QUERIES["op11_whitening"](spark, tiny).toPandas()
    assert len(got) == 4 * len(raw) and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for k in range(4):
        own = got[got.component == k + 1].set_index("vec_id").loc[raw.vec_id]
        assert own.deviation.tolist() == dev.tolist()
        sign = np.sign(own.whitened.to_numpy() @ w[:, k])
        assert np.allclose(own.whitened * sign, w[:, k], atol=1e-9) and np.allclose(own.explained, explained[k], rtol=1e-9)


def test_square_sums_are_exact_at_any_width():
    rng = np.random.default_rng(3)
    for bits in (3, 25, 44, 61):
        e = rng.integers(-(1 << bits), 1 << bits, (50, 7))
        want = [sum(int(v) ** 2 for v in e[:, c]) for c in range(7)]
        assert whitening.square_sums(e) == want == whitening.square_sums(e.astype(object))
    assert whitening.centred(np.array([[1 << 48]]), 1 << 20, np.array([5], object))[0, 0] == (1 << 68) - 5


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 3.0]), (None, [2.0, 2.0, -0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, n string")
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got if r.component == 1) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert {r.n for r in got} == {3} and {r.component for r in got} == {1, 2, 3}
    assert all(r.whitened is None for r in got if r.component == 3) and all(r.whitened is not None for r in got if r.component < 3)  # three points span two dimensions
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whitened(df.where("vec_id > 3 and vec_id < 9")).count() == 0 and whitening.whitened(df.limit(0)).count() == 0
    one = whitening.whitened(df.where("vec_id = 2")).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}


# Language model


def test_op12_counts_equal_brute_force(spark, tiny, texts):
    counts, docs = Counter(), {}
    for i, t in texts:
        docs[i] = [*(t or "").encode().lower().split(), b""]
        if not held_out(i):
            counts.update(docs[i])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.QUERIES["op12_lm_scoring"](spark, tiny).collect()}
    assert set(got) == set(docs)
    for i, words in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # learnt more than counts


def plain_log_prob(net, seq):
    """One symbol after the other, whole softmax over all symbols, in float64."""
    p = {k: x.astype(float) for k, x in net.p.items()}
    h, before, total, k = np.zeros(net.hidden), net.start, 0.0, net.hidden
    for y in seq:
        gx, rec = p["x"][before], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(gx[a : a + k] + rec[a : a + k]))) for a in (0, k))
        new = np.tanh(gx[2 * k :] + r * rec[2 * k :])
        h = z * h + (1 - z) * new
        c = h @ p["c"] + p["cb"]
        probs = []
        c = np.exp(c) / np.exp(c).sum()
        for run in range(net.runs):
            a, b = run * net.per_class, min(net.words, (run + 1) * net.per_class)
            w = np.exp(p["w"][a:b] @ h + p["wb"][a:b])
            probs.extend(c[run] * w / w.sum())
        probs.extend(c[net.runs :])
        assert math.isclose(sum(probs), 1.0, rel_tol=1e-9)
        total += math.log10(probs[y])
        before = y
    return total


def test_network_scores_and_gradients():
    rng = np.random.default_rng(5)
    net = recurrent.Network(10, 3, 4, 4, np.log(rng.dirichlet(np.ones(13))))
    seqs = [(i, rng.integers(0, 13, n).astype(np.uint16)) for i, n in enumerate([1, 7, 40, 3, 700, 25, 0, 12])]
    got = dict(recurrent.score(net, iter(seqs), lanes=3, steps=5, symbols=100))
    assert set(got) == {i for i, s in seqs if len(s)}  # an empty sequence has no score
    for i, s in seqs:
        if len(s):
            assert math.isclose(got[i], plain_log_prob(net, s.tolist()), rel_tol=1e-4)
    # The gradient of a window is that of its log probability.
    some = [s for _, s in seqs if 0 < len(s) < 30]
    x, y, first, live, _ = next(recurrent.windows(some, 3, 30, net.start))
    zero = np.zeros((x.shape[1], 4), np.float32)
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradient(grads, x, y, first, live, zero)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        kept, sides = net.p[k][at], []
        for step in (0.01, -0.01):
            net.p[k][at] = kept + step
            sides.append(net.gradient({n: np.zeros_like(v) for n, v in net.p.items()}, x, y, first, live, zero)[0])
        net.p[k][at] = kept
        assert math.isclose((sides[1] - sides[0]) / 0.02, grads[k][at], rel_tol=0.02)


def test_windows_hold_every_symbol_once():
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 50, n).astype(np.uint16) for n in (300, 1, 40, 8, 8, 5000, 17)]
    seen, starts = Counter(), 0
    for x, y, first, live, _ in recurrent.windows(seqs, 4, 8, 99):
        seen.update(y[live].tolist())
        starts += int(first.sum())
        assert (x[first] == 99).all()
    assert seen == Counter(np.concatenate(seqs).tolist()) and starts == len(seqs)


def test_a_window_of_training_keeps_its_memory():
    """Arrays made anew for every window cost page faults: after the first window most are there."""
    import tracemalloc

    rng = np.random.default_rng(8)
    net = recurrent.Network(1024, 129, 16, 32)
    seqs = [rng.integers(0, 1153, 40).astype(np.uint16) for _ in range(512)]
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    (x, y, first, live, _), second = list(recurrent.windows(seqs, 512, 16, net.start))[:2]
    _, h = net.gradient(grads, x, y, first, live, np.zeros((512, 16), np.float32))
    tracemalloc.start()
    net.gradient(grads, *second[:4], h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 << 20


def some_vocabulary(counts, most):
    top = sorted(counts.items(), key=lambda r: (-r[1], r[0]))
    ends = {}
    for w, n in top[2:]:
        own = ends.setdefault(w[-2:], [0, 0])
        own[0], own[1] = own[0] + n, own[1] + 1
    n, v = (list(x) for x in zip(*ends.values()))
    made = lm.Vocabulary([w for w, _ in top[:most]], [n for _, n in top[:most]], sum(counts.values()), len(counts), list(ends)[:-1], n, v)
    made.frequent = 2
    return made


def test_short_texts_are_counted_and_coded_in_columns(monkeypatch):
    """Without a Python object for each word; odd bytes, ends of texts and repeated words as brute force has them."""
    import pyarrow as pa

    texts = [b"", b" ", b"  a  B b ", b"\n", b"\xff\xfeA b\xc3", "ÄÖ x\u00a0y z ".encode(), bytes(range(256)), None, b"a", b"\t\x0b\x0cq\r\n", b"zz yz zz b a zz"]
    words = [[*(t or b"").lower().split(), b""] for t in texts]
    for most in (1, 16, 1 << 20):
        got = [[] for _ in texts]
        for rows, some in lm._tokens(pa.array(texts, pa.binary()), most):
            for i, w in zip(rows.tolist(), some.to_pylist(), strict=True):
                got[i].append(w)
        assert got == words

    def no(*_):
        raise AssertionError("words one by one")

    monkeypatch.setattr(lm, "word_blocks", no)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"]).slice(1)
    counts = Counter()
    for b in lm._counted(iter([batch])):
        counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert counts == Counter(w for some in words[1:] for w in some)
    v = some_vocabulary(counts, 4)

    class Shared:
        value = v

    keyed = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32()), pa.array(texts, pa.binary()), pa.array(["x"] * len(texts))], ["key", "part", "text", "c0"])
    got = [r for b in lm._coded(Shared)(iter([keyed.slice(0, 3), keyed.slice(3)])) for r in b.to_pylist()]
    assert [r["key"] for r in got] == list(range(len(texts))) and {r["c0"] for r in got} == {"x"}
    kind = lambda w: v.tails.get(w[-2:], v.other)
    for r, own in zip(got, words):
        place = [v.words.index(w) if w in v.words else -1 for w in own]
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [p if 0 <= p < 2 else 2 + kind(w) for p, w in zip(place, own)]
        assert (r["n_tokens"], r["known"]) == (len(own), sum(p >= 0 for p in place))
        assert math.isclose(r["base"], sum(math.log10((counts[w] + 1) / (v.n + v.v + 1)) for w, p in zip(own, place) if p >= 0), rel_tol=1e-12)
        assert math.isclose(r["tail"], sum(math.log10((counts[w] + 1) / (v.tail_n[kind(w)] + v.tail_v[kind(w)] + 1)) for w, p in zip(own, place) if p >= 2), rel_tol=1e-12)
        lacking = Counter(w for w, p in zip(own, place) if p < 0)
        assert dict(zip(r["rare_word"], zip(r["rare_n"], r["rare_kind"]))) == {w: (n, kind(w)) for w, n in lacking.items()} and len(r["rare_word"]) == len(lacking)


def test_a_symbol_costs_two_short_softmaxes():
    """Tail classes stand in runs as frequent words do: no softmax over all of them; all symbols' shares are 1 together."""
    tails = [bytes([97 + i // 26, 97 + i % 26]) for i in range(127)]
    v = lm.Vocabulary([b"%d" % i for i in range(2000)], list(range(3000, 1000, -1)), 5_000_000, 9000, tails, [500] * 128, [60] * 128)
    net = v.network()
    assert net.start == 1024 + 128 and net.classes + net.per_class <= 80
    h = np.random.default_rng(4).uniform(-1, 1, (1, net.hidden)).astype(np.float32)
    lp, _ = net.log_probs(np.repeat(h, net.start, axis=0), np.arange(net.start))
    assert math.isclose(float(np.exp(lp, dtype=float).sum()), 1.0, rel_tol=1e-4)


def test_lm_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, "the cat sat on the mat " * 40, "a"), (1, "the cat sat on the mat " * 40, "a"), (None, None, "b"), (3, "", "c"), (4, " \t\n", None), (5, "x" * 3_000_000, "e"), (6, "The cät sat", "f"), (7, "wort " * 300_000, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm.lm_scores(df.withColumn("c0", F.lit(1)), F.col("doc_id") == 6).collect()
    assert len(got) == len(rows) and all(r.c0 == 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_tokens for i in (None, 3, 4, 5, 6, 7)] == [1, 1, 1, 2, 3, 300_001] and by[6].held_out and not by[None].held_out
    assert by[6].n_known == 2  # "the" and the end; no-break spaces part no words
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 2 and math.isclose(twice[0].score, twice[1].score, rel_tol=1e-5)
    nothing = lm.lm_scores(df, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}
    assert lm.lm_scores(df.limit(0), F.lit(None).cast("boolean")).count() == 0
    assert [w for b in lm.word_blocks(b"Ab c\x0bd e" * 50, 16) for w in b] == (b"Ab c\x0bd e" * 50).lower().split()


# Divergence


def brute_divergence(rows):
    import re

    docs = [(t or "", a or "", s or "") for t, a, s in rows]
    terms = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    out = set()
    for lang in {a for _, a, _ in docs}:
        own = [(i, s) for i, (_, a, s) in enumerate(docs) if a == lang]
        df = Counter(w for i, _ in own for w in set(terms[i]))
        kept = sorted(w for w, c in df.items() if c >= 10)
        whole, by = Counter(), {s: Counter() for _, s in own}
        for i, s in own:
            by[s].update(w for w in terms[i] if df[w] >= 10)
            whole.update(w for w in terms[i] if df[w] >= 10)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, ps = p(whole), {s: p(c) for s, c in by.items()}
        for s in by:
            pairs = sorted(((-sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in by if o != s), key=lambda x: (x[0], x[1].encode()))
            best = sorted(((-f(ps[s][w], q[w]), w) for w in kept if by[s][w] and ps[s][w] > q[w]), key=lambda x: (x[0], x[1].encode()))[:10]
            out |= {(lang, s, part, o, -v, r + 1) for part, some in (("pair", pairs), ("term", best)) for r, (v, o) in enumerate(some)}
    return out


def test_op13_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = con.execute(queries.SQL["op13_source_divergence"]).fetchall()
    df = queries.QUERIES["op13_source_divergence"](spark, tiny)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_divergence_edges(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 8)  # several blocks a level
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "éà", "Z", "ÿ"]
    rows = [(" ".join(rng.choice(words, 30)), "xx", f"s{i % 4}") for i in range(60)]
    rows += [(None, "xx", None), ("", "xx", "empty"), ("1234 .. !!", "xx", "s0"), (rows[0][0],) + rows[0][1:], (rows[0][0],) + rows[0][1:]]
    rows += [("rare word", None, "s1"), ("other", None, None), ("alone", "yy", "s1")] + [("wa\u0000wb", "xx", "s9")] * 12
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).selectExpr("*", "1 AS n", "2 AS value")
    got = {tuple(r) for r in divergence.source_divergence(df).collect()}
    assert got == brute_divergence(rows)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_runs_are_fewer_than_places():
    a, b = np.array([5] * 40 + [7] * 10 + [9]), np.array([1] * 20 + [2] * 31)
    at_a, at_b = divergence.runs(a), divergence.runs(b)
    assert at_a.tolist() == [0, 40, 50] and at_b.tolist() == [0, 20]
    assert divergence.pair_sum(a[at_a], at_a, b[at_b], at_b, 51) == int(divergence.divergence(a, b).sum())
