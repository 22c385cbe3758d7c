"""Language-model scores: corpus counts, a gated recurrent model learnt over all training texts, and whole-text likelihoods.

Words are counted over the whole corpus by their 64-bit hashes (two words share one with a chance of 2^-64). The ``WORDS``
most frequent ones are symbols of the recurrent model of :mod:`spanlake.llm.gru`; every other word belongs to a tail class by
its last two bytes, within which its probability is its smoothed share. So the model is a distribution over the same words as
the base: those of the training texts and one unknown word per class.

Texts are cut into symbols once and stored. The counts of the ``KNOWN`` most frequent words go to the tasks; those of rarer
words are joined by hash, and as no frequent word is left there, no key is hot. Learning takes ``ROUNDS`` rounds, each over
another part of the training texts: every task goes through its texts from the model of the round before, and the tasks'
models are averaged by tokens, piece by piece, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import gru
from spanlake.llm.blocks import LOWER, Block, blocks, byte_class, sums, xxh64
from spanlake.llm.storage import stored

#: Words that the recurrent model tells apart, classes of all others, and words whose counts every task holds.
WORDS, TAILS, KNOWN = 2048, 32, 1 << 17
ROUNDS = 4
#: Symbols that are learnt from together, and that are scored together: the longest texts of more symbols fill more lanes.
TOKENS, SCORED_TOKENS = 1 << 20, 1 << 22
#: Numbers of a model that one row carries while models are averaged.
PIECE = 1 << 14
#: Added to each count.
PRIOR = 0.1

WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: The end of a text as a token: a fixed number in the place of a word's hash.
END = np.uint64(0x8A19_9FD4_0000_0001)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last two bytes of the tokens of a block, ends included, and the bounds of each text among them."""
    start, end = block.runs(WORD)
    data = LOWER[block.data]
    bounds = block.of_text(start)
    ends = bounds[1:]
    hashes = np.insert(xxh64(data, start, end), ends, END)
    last = data[end - 1].astype(np.int32)
    before = np.where(end - start > 1, data[end - 2], 0) if len(end) else last
    return _signed(hashes), np.insert(last + 256 * before.astype(np.int32), ends, -1), bounds + np.arange(len(bounds))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(h, tail, c)``: hash, last two bytes (-1 for the end of texts) and number of each token of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                hashes, tail, _ = tokens_of(block)
                h, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(tail[first].astype(np.int32)), pa.array(n)], names=["h", "tail", "c"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h long, tail int, c long")
    return parts.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What the tasks know of the corpus: sorted hashes of the known words with their counts and symbols (-1: none), the class
    of each pair of last bytes, and by class the tokens and distinct words outside the vocabulary."""

    known: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    tail_class: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    top: np.ndarray
    n: int
    v: int

    @property
    def shape(self) -> gru.Shape:
        return gru.Shape(len(self.top), len(self.tail_tokens))

    @property
    def start_counts(self) -> np.ndarray:
        return np.concatenate([self.top, self.tail_tokens]).astype(float)

    @property
    def tail_logs(self) -> np.ndarray:
        """log10 of what a count in a tail class is divided by."""
        return np.log10(self.tail_tokens + PRIOR * (self.tail_words + 1))


def vocabulary(counts: DataFrame, words: int = WORDS, tails: int = TAILS, known: int = KNOWN) -> Vocabulary:
    """From ``(h, tail, c)``. At most ``known`` words and one row per pair of bytes come to the driver."""
    best = counts.orderBy(F.desc("c"), "h").limit(max(known, words)).select("h", "tail", "c").toArrow()
    h, tail, c = (best[name].to_numpy().astype(np.int64) for name in ("h", "tail", "c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    is_end = h == np.int64(END.view(np.int64))
    # the end of texts is always a symbol; it may be no frequent token where texts are long
    end_count = int(c[is_end][0]) if is_end.any() else None
    if end_count is None and (row := counts.where(F.col("tail") == -1).first()):
        h, tail, c = np.append(h, row.h), np.append(tail, -1), np.append(c, row.c)
    is_end = tail == -1
    order = np.concatenate([np.flatnonzero(~is_end)[: max(words - 1, 0)], np.flatnonzero(is_end)])
    order = order[np.argsort(-c[order], kind="stable")]
    symbol = np.full(len(h), -1)
    symbol[order] = np.arange(len(order))
    of_tail = np.zeros((1 << 16, 2), np.int64)
    for row in counts.where("tail >= 0").groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toLocalIterator():
        of_tail[row.tail] = row.n, row.v
    inside = order[tail[order] >= 0]
    np.add.at(of_tail, tail[inside], -np.column_stack([c[inside], np.ones(len(inside), np.int64)]))
    frequent = np.argsort(-of_tail[:, 0], kind="stable")[: tails - 1]
    tail_class = np.full(1 << 16, tails - 1)
    tail_class[frequent] = np.arange(len(frequent))
    by_class = lambda i: np.bincount(tail_class, of_tail[:, i], tails).astype(np.int64)
    at = np.argsort(h)
    return Vocabulary(h[at], c[at], symbol[at], tail_class, by_class(0), by_class(1), c[order], total.n or 0, total.v or 0)


_SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_sum", T.DoubleType()),
        T.StructField("tail_sum", T.DoubleType()),
        T.StructField("symbols", T.BinaryType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("rare_n", T.ArrayType(T.LongType())),
    ]
)


def with_symbols(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the text's symbols, numbers of tokens and of known ones, the sums of log10(c + PRIOR) of
    its known tokens and of those in tail classes, and hash and number of each of its tokens that is not known here."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), *_SCORED.fields])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_count = np.log10(v.count + PRIOR)
        size = np.append(v.known, 0)
        for batch in batches:
            for at, to, block in blocks(batch.column(len(kept))):
                hashes, tail, bounds = tokens_of(block)
                place = np.searchsorted(v.known, hashes)
                known = size[place] == hashes
                known &= place < len(v.known)
                place[~known] = 0
                symbol = np.where(known, v.symbol[place], -1) if len(v.known) else np.full(len(hashes), -1)
                in_tail = symbol < 0
                # only without any training text is the end of a text no symbol
                symbol = np.where(in_tail, v.shape.words + v.tail_class[np.maximum(tail, 0)], symbol).astype("<u2")
                logs = np.where(known, log_count[place], 0.0) if len(v.known) else np.zeros(len(hashes))
                text_of = np.repeat(np.arange(to - at), np.diff(bounds))
                other = np.flatnonzero(~known)
                order = other[np.lexsort((hashes[other], text_of[other]))]
                new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])])[: len(order)]
                first = np.flatnonzero(new)
                lists = np.searchsorted(text_of[order][first], np.arange(to - at + 1)).astype(np.int32)
                flat = np.ascontiguousarray(symbol)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(at, to - at) for c in batch.columns[: len(kept)]),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(sums(known, bounds)),
                        pa.array(sums(logs, bounds)),
                        pa.array(sums(np.where(in_tail, logs, 0.0), bounds)),
                        pa.array([flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                        pa.ListArray.from_arrays(lists, pa.array(hashes[order][first])),
                        pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(first, len(order))).astype(np.int64))),
                    ],
                    names=schema.fieldNames(),
                )

    source = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows together, up to about ``most`` symbols, with their symbol arrays."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size >= most:
            table = pa.Table.from_batches(held)
            yield table, [np.frombuffer(s, "<u2") for s in table[column].to_pylist()]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, [np.frombuffer(s, "<u2") for s in table[column].to_pylist()]


def _round(texts: DataFrame, model: gru.Model) -> gru.Model:
    """The mean, weighted by tokens, of the models that the tasks make of ``model`` with their texts."""
    spark = texts.sparkSession
    shared, shape = spark.sparkContext.broadcast(model.flat), model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, key = gru.Model(shape, shared.value.copy()), 0, None
        for table, symbols in _gathered(batches, "symbols", TOKENS):
            key = table["__row"][0].as_py() if key is None else key
            own.learn_texts(symbols)
            n += sum(map(len, symbols))
        if n:
            pieces = [own.flat[at : at + PIECE].tobytes() for at in range(0, len(own.flat), PIECE)]
            m = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(m), pa.int32()), pa.array([key] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(pieces, pa.binary())],
                names=["piece", "key", "n", "v"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = sums.setdefault(piece, [0, 0.0])
                own[0] += n
                own[1] = own[1] + n * np.frombuffer(v, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in sums.values()], pa.binary())], names=["piece", "v"]
        )

    # no more tasks than run at once, since each gives a whole model
    parts = texts.select("__row", "symbols").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "piece int, key long, n long, v binary")
    # in a fixed order, so that the sums come out alike each time
    merged = parts.repartition("piece").sortWithinPartitions("piece", "key").mapInArrow(added, "piece int, v binary")
    flat = model.flat.copy()
    for row in merged.toLocalIterator():  # one model in all
        new = np.frombuffer(row.v, np.float32)
        flat[row.piece * PIECE : row.piece * PIECE + len(new)] = new
    return gru.Model(shape, flat)


def learn(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> gru.Model:
    """A model of all texts in ``(__row, __part, symbols)``; round i takes those whose part is i."""
    model = gru.Model.start(vocab.shape, vocab.start_counts)
    for i in range(rounds):
        model = _round(texts.where(F.col("__part") == i), model)
    return model


def with_model_score(texts: DataFrame, model: gru.Model, vocab: Vocabulary, out: str = "__model") -> DataFrame:
    """``texts`` with ``out`` in the place of the symbols: log10 of the probability of the whole sequence of symbols, less the
    divisors of its tail classes."""
    kept = [c for c in texts.columns if c != "symbols"]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    shared = texts.sparkSession.sparkContext.broadcast((model.flat, vocab.tail_logs))
    shape = vocab.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, tail_logs = shared.value
        own = gru.Model(shape, flat.copy())
        divisor = np.concatenate([np.zeros(shape.words), tail_logs])
        for table, symbols in _gathered(batches, "symbols", SCORED_TOKENS):
            score = own.score(symbols) / np.log(10)
            score -= np.array([divisor[s].sum() for s in symbols])
            for batch in table.select(kept).append_column(out, pa.array(score)).combine_chunks().to_batches():
                yield batch

    return texts.select(*kept, "symbols").mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, tails: int = TAILS, known: int = KNOWN) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    A null or empty text has one token, its end. Repeated rows count each by itself. Without any training text both scores
    are 0: the one unknown word is certain. A text of any length is one sequence. Empty tables give no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("__text"))
    counts = stored(word_counts(rows.where(~F.col("held_out")), "__text"))
    vocab = vocabulary(counts, words, tails, known)
    part = F.pmod(F.xxhash64("__row"), F.lit(ROUNDS)).cast("int")
    keyed = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", part)
    texts = stored(with_symbols(keyed, vocab, "__text"))
    if vocab.n:
        model = learn(texts.where(~F.col("held_out")), vocab)
        scored = with_model_score(texts.select(id_col, "held_out", "__row", "n_tokens", "n_known", "base_sum", "tail_sum", "symbols"), model, vocab)
    else:
        scored = texts.withColumn("__model", F.lit(0.0))
    # (row, hash) pairs of tokens beyond the known ones; a token that no training text has meets no count
    rare = texts.select("__row", F.explode(F.arrays_zip("rare", "rare_n")).alias("e")).select("__row", F.col("e.rare").alias("h"), F.col("e.rare_n").alias("m"))
    met = rare.join(counts.select("h", "c"), "h", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(PRIOR))
    beyond = met.groupBy("__row").agg(F.sum(F.col("m") * log).alias("__log"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("__n"))
    all_of = scored.join(beyond, "__row", "left")
    log_sum, n_more = F.coalesce("__log", F.lit(0.0)), F.coalesce("__n", F.lit(0))
    divisor = float(np.log10(vocab.n + PRIOR * (vocab.v + 1)))
    base = F.col("base_sum") + log_sum - F.col("n_tokens") * F.lit(divisor)
    own = F.col("__model") + F.col("tail_sum") + log_sum
    none = F.lit(0.0)
    return all_of.select(
        F.col(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + n_more).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (base if vocab.n else none).alias("base_score"),
        (own if vocab.n else none).alias("score"),
    )
