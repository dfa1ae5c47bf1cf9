"""LM scoring: a gated recurrent network trained here, with word counts of the whole training corpus under it.

A token is a frequent word, which the network knows by itself, or stands in a tail class: the words that end in the same
two bytes. ``P(token) = P(frequent word | state)``, or ``P(tail class | state) * (c + 1) / (N_class + V_class + 1)`` with
the word's count c in the training documents. Frequent words and tail classes are the network's symbols, in runs of
PER_CLASS: ``P(symbol | state) = P(run | state) * P(symbol | run, state)``. So each class has one symbol for all unknown
words, and the sum over all tokens is 1. Counts, frequent words, classes and N, V are those of all training documents;
the network sees each of them once, from its first word to its end.

Work is dealt out as follows. One scan counts words (pre-aggregated in each task). One scan codes the texts: what the
bounded dictionary of most frequent words knows is coded and summed there, the other words of each document are joined
to the counts; none of them can have more than 1 / DICTIONARY of the training tokens. Training goes in four rounds over
1, 1, 2 and 4 eighths of the documents: each task trains from the round's first weights on about TASK_TOKENS tokens, and
weights are averaged by tokens, in blocks, on executors. Scoring is one scan over the codes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm import recurrent
from gridwright.llm.common import keep, shared_dir, short_batches
from gridwright.llm.shingles import pieces

WORDS = 1024  # most frequent words that the network tells apart
TAILS = 128  # tail classes: the most frequent last two bytes, and one for the others
DICTIONARY = 60_000  # most frequent words whose counts every task holds, of LONGEST bytes at most: some 4 MB at the most
LONGEST = 64
COUNTED = 32 << 20  # bytes of words, with four for each word's place, that a task counts before it sends them on
HIDDEN, PER_CLASS, LANES, STEPS, RATE = 16, 32, 512, 16, 0.006
TASK_TOKENS = 2_000_000  # about as many train one replica in a round
BLOCK = 8192  # weights averaged at once
ROUNDS = (1, 1, 2, 4)  # eighths of the training documents, short rounds first, so that replicas part little
_NO_BYTES = 65536 + 256  # place of the empty word among last two bytes, after those of two and of one
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def word_blocks(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in blocks of about ``most`` bytes of whole words."""
    at = 0
    while len(text) - at > most:
        cut = _SPACE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()].lower().split()
        at = cut.start()
    yield text[at:].lower().split() if at else text.lower().split()


def _tokens(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each token, tokens as binary), rows ascending, about ``most`` bytes of text at once; a document's end is the empty word."""
    texts = pc.fill_null(texts, b"")
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, at = np.cumsum(length), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        if length[at] > most:  # long texts in several turns
            for words in word_blocks(texts[at].as_py()):
                yield np.full(len(words), at), pa.array(words, pa.binary())
            yield np.array([at]), pa.array([b""], pa.binary())
        else:
            # With a space behind each text, what the split finds last is the end. Only the first can be empty besides.
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(texts[at:to].view(pa.string()), " ", "")))
            words = split.flatten().view(pa.binary())
            rows = np.repeat(np.arange(at, to), np.diff(split.offsets.to_numpy()))
            empty = pc.binary_length(words).to_numpy() == 0
            empty[np.flatnonzero(np.append(rows[1:] != rows[:-1], True))] = False
            if empty.any():
                rows, words = rows[~empty], words.filter(pa.array(~empty))
            yield rows, words
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), pre-aggregated; a document's end is the empty word."""

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(some, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    some, held = [], 0
    for b in (p for whole in batches for p in pieces(whole, 1024)):
        for _, words in _tokens(b.column(0)):
            some.append(words)
            held += words.nbytes
            if held > COUNTED:
                yield out()
                some, held = [], 0
    yield out()


class Vocabulary:
    """What every task knows of the training corpus: N, V, the dictionary with counts, the tail classes' totals."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int, tails: list[bytes], tail_n: list[int], tail_v: list[int]):
        self.n, self.v = n, v
        self.words, self.counts = words, np.array(counts, float)
        self.frequent = min(WORDS, len(words))
        self.tails = {s: i for i, s in enumerate(tails)}
        self.other = len(tails)
        self.tail_n, self.tail_v = np.array(tail_n, float), np.array(tail_v, float)

    def kinds(self, words: pa.Array) -> np.ndarray:
        """Tail class of each word, by its last two bytes."""
        if not len(words):
            return np.zeros(0, np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        length, ends = np.diff(ends), ends[1:]
        last = np.full(len(words), _NO_BYTES)
        some, more = np.flatnonzero(length > 0), np.flatnonzero(length > 1)
        last[some] = 65536 + data[ends[some] - 1].astype(np.int64)
        last[more] = data[ends[more] - 2].astype(np.int64) * 256 + data[ends[more] - 1]
        table = np.full(_NO_BYTES + 1, self.other)
        for w, i in self.tails.items():
            table[_NO_BYTES if not w else 65536 + w[0] if len(w) == 1 else w[0] * 256 + w[1]] = i
        return table[last]

    def coder(self):
        """A function from words to (code, symbol, base and tail share of each, what the dictionary lacks with its tail classes).

        Codes are places in the dictionary, and from its length on in what it lacks, which is each word once.
        """
        known, k, n = pa.array(self.words, pa.binary()), self.frequent, len(self.words)
        kinds, place = self.kinds(known), np.arange(n)
        symbol = np.where(place < k, place, k + kinds).astype(np.uint16)
        base = np.log10((self.counts + 1) / (self.n + self.v + 1))
        tail = np.where(place < k, 0.0, np.log10((self.counts + 1) / (self.tail_n[kinds] + self.tail_v[kinds] + 1)))

        def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
            found = pa.concat_arrays([known, words]).dictionary_encode()
            code, lacking = found.indices.to_numpy()[n:], found.dictionary[n:]
            own = self.kinds(lacking)
            none = np.zeros(len(lacking))
            return code, np.append(symbol, (k + own).astype(np.uint16))[code], np.append(base, none)[code], np.append(tail, none)[code], lacking, own

        return run

    def log_share(self) -> np.ndarray:
        """Log share of each frequent word and tail class, unknown words counted once a class."""
        mass = np.concatenate([self.counts[: self.frequent], self.tail_n + 1.0])
        return np.log(mass / mass.sum())

    def network(self) -> recurrent.Network:
        return recurrent.Network(self.frequent + self.other + 1, 0, HIDDEN, PER_CLASS, self.log_share())


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``counts(word, n)``: the driver sees DICTIONARY short words, a row for each two last bytes, and sums."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    words = [bytes(r.word) for r in top]
    frequent = counts.sparkSession.createDataFrame([(w,) for w in words[:WORDS]], "word binary")
    ends = counts.join(F.broadcast(frequent), "word", "left_anti").groupBy(F.substring("word", -2, 2).alias("last")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    ends = sorted(((bytes(r.last), r.n, r.v) for r in ends.collect()), key=lambda r: (-r[1], r[0]))  # 65,792 rows at most
    own, rest = ends[: TAILS - 1], ends[TAILS - 1 :]
    return Vocabulary(
        words, [r.n for r in top], sums.n, sums.v, [r[0] for r in own],
        [*(r[1] for r in own), sum(r[1] for r in rest)], [*(r[2] for r in own), sum(r[2] for r in rest)],
    )


_CODED = "key long, part int, n_tokens long, known long, base double, tail double, ids binary, rare_word array<binary>, rare_n array<int>, rare_kind array<int>"


def _coded(vocab) -> object:
    """Texts as symbols, with sums over the dictionary's words, and the other words with counts and tail classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        coder, known = v.coder(), len(v.words)
        for b in (p for whole in batches for p in pieces(whole, 1024)):
            n = b.num_rows
            sums, lacks, ids = np.zeros((4, n)), np.zeros(n, np.int64), []  # tokens, known, base, tail
            rare = [(pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int32))]
            for rows, words in _tokens(b.column(2)):
                code, symbol, base, tail, lacking, kinds = coder(words)
                ids.append(symbol)
                for i, x in enumerate((None, code < known, base, tail)):
                    sums[i] += np.bincount(rows, x, n)
                gaps = np.flatnonzero(code >= known)
                pairs, times = np.unique(rows[gaps] * len(lacking) + (code[gaps] - known), return_counts=True)
                row, word = np.divmod(pairs, max(1, len(lacking)))
                lacks += np.bincount(row, minlength=n)
                rare.append((lacking.take(pa.array(word)), times.astype(np.int32), kinds[word].astype(np.int32)))
            at = pa.array(np.append(0, np.cumsum(lacks)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.concat_arrays([r[0] for r in rare]), *(pa.array(np.concatenate([r[i] for r in rare])) for i in (1, 2)))]
            ends = np.append(0, np.cumsum(2 * sums[0])).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])
            own = [*(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2]), pa.array(sums[3]), coded]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, *lists, *b.columns[3:]], ["key", "part", "n_tokens", "known", "base", "tail", "ids", "rare_word", "rare_n", "rare_kind", *b.schema.names[3:]])

    return run


def _sequences(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for b in (p for whole in batches for p in pieces(whole)):
        for x in b.column(column):
            yield np.frombuffer(x.as_buffer(), np.uint16)


def _trained(vocab, weights):
    """The weights that one replica ends with, in blocks: (block, symbols, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = vocab.value.network()
        if weights is not None:
            net.load(weights.value)
        seen, _ = recurrent.fit(net, _sequences(batches), LANES, STEPS, RATE)
        if seen:
            flat = net.flat()
            cut = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([seen] * len(cut), pa.int64()), pa.array(cut, pa.binary())], ["block", "symbols", "weights"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the blocks that a task gets, weighted by symbols, one sum for each block."""
    sums: dict[int, list] = {}
    for b in batches:
        for block, n, values in zip(*(c.to_pylist() for c in b.columns)):
            own = sums.setdefault(block, [0, 0.0])
            own[0] += n
            own[1] = own[1] + n * np.frombuffer(values, np.float32).astype(float)
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())], ["block", "weights"])


def train(coded: DataFrame, vocab, tokens: dict[int, int]) -> np.ndarray:
    """Weights after one pass over ``coded(part, ids)``, whose parts 0 to 3 are the rounds; ``tokens`` by part."""
    spark = coded.sparkSession
    flat = vocab.value.network().flat()
    for part in range(len(ROUNDS)):
        if not tokens.get(part):
            continue
        now = spark.sparkContext.broadcast(flat)
        own = coded.where(F.col("part") == part).select("ids").coalesce(-(-tokens[part] // TASK_TOKENS))
        ends = own.mapInArrow(_trained(vocab, now), "block int, symbols long, weights binary")
        means = ends.repartition("block").mapInArrow(_averaged, "block int, weights binary").collect()
        flat = np.concatenate([np.frombuffer(bytes(r.weights), np.float32) for r in sorted(means, key=lambda r: r.block)])
        now.destroy()
    return flat


def _scores(vocab, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = vocab.value.network()
        net.load(weights.value)

        def keyed() -> Iterator[tuple[int, np.ndarray]]:
            for b in (p for whole in batches for p in pieces(whole)):
                for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                    yield k, np.frombuffer(x.as_buffer(), np.uint16)

        keys, sums = [], []
        for k, lp in recurrent.score(net, keyed()):
            keys.append(k)
            sums.append(lp)
            if len(keys) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.float64())], ["key", "lp"])
                keys, sums = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.float64())], ["key", "lp"])

    return run


def lm_scores(docs: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is the log10 probability of the whole text and its end by a model trained on the rows where ``held_out`` is
    false, ``base_score`` that by the training counts with one added. Columns of these names are replaced.

    Null texts are empty ones: their only token is the end. A null ``held_out`` counts as false. Rows come back as often
    as they are there, whatever their ids; repeated rows have equal scores. Texts are read whole at any length. Without
    training rows nothing is known and both scores are 0; an empty table stays empty.
    """
    spark = docs.sparkSession
    short_batches(spark)
    made = {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    names = [c for c in docs.columns if c != text_col and c not in made]
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    counts = keep(rows.where("not held").select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "lm-counts")
    v = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(v)

    key = F.monotonically_increasing_id()  # written below with the row, so it stays the row's
    shape = ", ".join([_CODED, *(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))])
    slot = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(sum(ROUNDS)))
    edges = np.cumsum(ROUNDS).tolist()
    part = F.when(F.col("held"), -1)
    for i, end in enumerate(edges):
        part = part.when(slot < end, i)
    keyed = rows.withColumn("key", key).withColumn("part", part.cast("int")).select("key", "part", "text", *[f"c{i}" for i in range(len(names))])
    path = f"{shared_dir(spark)}/gridwright/lm-coded-{uuid.uuid4().hex}"
    keyed.mapInArrow(_coded(vocab), shape).write.partitionBy("part").parquet(path)
    coded = spark.read.schema(shape).parquet(path)

    total = float(v.n + v.v + 1)
    rare = coded.where(F.size("rare_word") > 0).select("key", F.explode(F.arrays_zip("rare_word", "rare_n", "rare_kind")).alias("r")).select("key", F.col("r.rare_word").alias("word"), F.col("r.rare_n").alias("times"), F.col("r.rare_kind").alias("kind"))
    c = F.coalesce(F.col("n"), F.lit(0)) + F.lit(1.0)
    within = F.element_at(F.array(*[F.lit(float(a + b + 1)) for a, b in zip(v.tail_n, v.tail_v)]), F.col("kind") + 1)
    looked = rare.join(counts, "word", "left").select(
        "key", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("known"),
        (F.log10(c / total) * F.col("times")).alias("base"), (F.log10(c / within) * F.col("times")).alias("lp"),
    )
    parts = looked.groupBy("key").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    if v.n:
        tokens = {r.part: r.n for r in coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
        weights = spark.sparkContext.broadcast(train(coded, vocab, tokens))
        # Many symbols a task: its longest documents then go with more others at once.
        tasks = max(spark.sparkContext.defaultParallelism, -(-sum(tokens.values()) // TASK_TOKENS))
        lp = coded.select("key", "ids").coalesce(tasks).mapInArrow(_scores(vocab, weights), "key long, lp double")
        parts = parts.unionByName(lp.select("key", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "lp"))
    parts = parts.groupBy("key").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("lp").alias("lp"))
    done = coded.join(parts, "key", "left")
    sum_of = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return done.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("part") == -1).alias("held_out"), "n_tokens",
        sum_of("known", "more_known").alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        sum_of("base", "more_base").alias("base_score"), (sum_of("tail", "lp") if v.n else F.lit(0.0)).alias("score"),
    )
