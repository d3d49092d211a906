"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before it, times that of its subclass in
the class, times that of its group in the subclass, times its smoothed share of its group. Classes and
subclasses are hashes of the token's last bytes, groups of the whole token: 16 of each, 4,096 groups
in all. Each of the three factors is a softmax over the same hashed features of the words themselves:
the token before, the one before that (a skip), and both (an n-gram), each with the classes fixed so
far. A factor's bias is the share of its choice in all training tokens.

Training is by distributed gradient updates over all training texts: every round sums, over all
partitions, how often each feature was seen with each choice, and how often the model expects it; the
weights then move by the logarithm of observed over expected, both smoothed, in one shared state, so
partitions only change the order of sums. For the first round, before which all weights are zero, what
the model expects follows from the counts alone. Token counts over all training texts come from an
exchange. Scoring works in numpy batches over the rows of the features at hand.

A token that no training text has gets the probability it has in the base score. Null and empty texts
are one end token. Rows with equal ids share a fold and count each; a null id is the empty text. An
empty table gives an empty result; without training texts all tokens are unknown. Other columns are
not looked at.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Answers, exchange, numbered, summaries
from .storage import as_scan, scanned_bytes
from .words import LOWERED, Block, hash_spans, mixed, spans

#: Choices of a factor, factors, and the groups of tokens that they tell apart.
FAN, FACTORS = 16, 3
GROUPS = FAN**FACTORS
#: Hashed rows of each feature in each factor, a power of two; the classes fixed so far are their first bits.
ROW_BITS = 15
ROWS = 1 << ROW_BITS
#: Features: the token before, the one before that, both.
FEATURES = 3
#: Prior weight, in tokens, of what the model has of a row already.
SMOOTH = 32.0
#: How far weights move in a round, for each feature.
RATES = (0.5, 0.35, 0.55)
#: Bytes of text in a block, tokens in a numpy step.
BLOCK_BYTES = 8 << 20
BATCH = 1 << 16
_END = np.uint64(0xA5A5F00D5EED0001)
_ONES = np.ones(FAN, np.float32)
#: Largest weight of a feature.
LIMIT = 20.0
#: Pieces in which sums come to the driver, and tasks whose sums are added first.
CHUNKS, NEAR = 64, 128
#: Bytes of input files that a summing task reads at least, once there are two tasks a core.
TASK_BYTES = 64 << 20


class Tokens:
    """Tokens of a block with an end after each text: hashes, groups and bounds."""

    def __init__(self, block: Block):
        starts, ends = spans(block.raw, block.offsets, LOWERED)
        words = hash_spans(block.raw, starts, ends, LOWERED)
        texts = np.searchsorted(starts, block.offsets)
        length = ends - starts
        last = [np.where(length > k, LOWERED[block.raw[np.maximum(ends - 1 - k, 0)]], np.uint64(0)) if len(ends) else words for k in range(3)]
        ending = (last[0] * np.uint64(257) + last[1]) * np.uint64(0x9E3779B97F4A7C15)
        longer = ((last[0] * np.uint64(257) + last[1]) * np.uint64(257) + last[2]) * np.uint64(0xD6E8FEB86659FD93)
        bits = np.uint64(60)
        group = (ending >> bits) << np.uint64(8) | (longer >> bits) << np.uint64(4) | words >> bits
        n = len(texts) - 1
        place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(texts))
        self.bounds = texts + np.arange(n + 1)
        self.hashes = np.full(len(words) + n, _END)
        self.hashes[place] = words
        self.groups = np.full(len(words) + n, int(_END >> np.uint64(52)), np.int16)
        self.groups[place] = group.astype(np.int16)

    def features(self) -> list[np.ndarray]:
        """Hashes of the features of each token's history; before a text there are ends."""
        first = self.bounds[:-1]
        before = [np.full(len(self.hashes), _END) for _ in range(2)]
        for back, column in enumerate(before, 1):
            column[back:] = self.hashes[:-back]
            for k in range(back):
                at = first + k
                column[at[at < self.bounds[1:]]] = _END
        one, two = before
        return [mixed(one), mixed(two ^ np.uint64(0x51ED270B7A1C9E35)), mixed(one * np.uint64(3) + two * np.uint64(0xD6E8FEB86659FD93))]


def feature_rows(features: list[np.ndarray], groups: np.ndarray) -> list[list[np.ndarray]]:
    """For each factor and feature the rows of tokens: the choices fixed so far, then hashed bits."""
    out = []
    for k in range(FACTORS):
        fixed = (groups >> (4 * (FACTORS - k))).astype(np.uint16) << np.uint16(ROW_BITS - 4 * k) if k else np.uint16(0)
        out.append([(f >> np.uint64(64 - ROW_BITS + 4 * k)).astype(np.uint16) | fixed for f in features])
    return out


def choices(groups: np.ndarray, k: int) -> np.ndarray:
    return (groups >> (4 * (FACTORS - 1 - k))) & (FAN - 1)


class Model:
    """Biases and weights of the factors."""

    def __init__(self, mass: np.ndarray):
        """mass: tokens of each group in all training texts, smoothed."""
        self.bias = []
        for k in range(FACTORS):
            table = mass.reshape(FAN**k, FAN, -1).sum(axis=2)
            self.bias.append(np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))
        self.weights = [np.zeros((FEATURES, ROWS, FAN), np.float32) for _ in range(FACTORS)]

    def scores(self, k: int, rows: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
        """Exponents of all choices of a factor, for each token; weights are bounded, so none overflows."""
        z = self.bias[k].take(groups >> (4 * (FACTORS - k)), axis=0) if k else np.repeat(self.bias[0], len(groups), axis=0)
        for f, r in enumerate(rows):
            z += self.weights[k][f].take(r, axis=0)
        return z

    def probabilities(self, k: int, rows: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
        """Of all choices of a factor, for each token."""
        z = self.scores(k, rows, groups)
        np.exp(z, out=z)
        z *= (1 / (z @ _ONES))[:, None]
        return z

    def log_probability(self, features: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's group."""
        out = np.zeros(len(groups))
        at = np.arange(len(groups)) * FAN
        for k, rows in enumerate(feature_rows(features, groups)):
            z = self.scores(k, rows, groups)
            out += z.reshape(-1).take(at + choices(groups, k))
            np.exp(z, out=z)
            out -= np.log(z @ _ONES)
        return out

    def shares(self, k: int) -> np.ndarray:
        """Of each row's choices in all training tokens, whatever the feature."""
        return np.repeat(np.exp(self.bias[k]), ROWS // FAN**k, axis=0)

    def move(self, observed: list[np.ndarray], expected: list[np.ndarray] | None) -> None:
        """A step along the gradient; expected: None while all weights are zero."""
        for k in range(FACTORS):
            share = self.shares(k)
            for f, rate in enumerate(RATES):
                seen = observed[k][f]
                had = expected[k][f] if expected else seen.sum(axis=1, keepdims=True) * share
                self.weights[k][f] += (rate * np.log((seen + SMOOTH * share) / (had + SMOOTH * share))).astype(np.float32)
                np.clip(self.weights[k][f], -LIMIT, LIMIT, out=self.weights[k][f])


class Sums:
    """Sums over tokens of what is observed, or expected, by factor, feature, row and choice."""

    def __init__(self):
        self.of = [np.zeros((FEATURES, ROWS, FAN)) for _ in range(FACTORS)]

    def observe(self, features: list[np.ndarray], groups: np.ndarray) -> None:
        for k, rows in enumerate(feature_rows(features, groups)):
            chosen = choices(groups, k).astype(np.int64)
            for f, r in enumerate(rows):
                self.of[k][f] += np.bincount(r.astype(np.int64) * FAN + chosen, minlength=ROWS * FAN).reshape(ROWS, FAN)

    def expect(self, model: Model, features: list[np.ndarray], groups: np.ndarray) -> None:
        for k, rows in enumerate(feature_rows(features, groups)):
            p = model.probabilities(k, rows, groups)
            for f, r in enumerate(rows):
                order = np.argsort(r, kind="stable")
                sorted_ = r[order]
                starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
                self.of[k][f][sorted_[starts]] += np.add.reduceat(p.take(order, axis=0), starts, axis=0)

    def chunks(self) -> list[tuple[int, bytes]]:
        flat = np.concatenate([x.reshape(-1) for x in self.of]).astype(np.float32)
        return [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(np.array_split(flat, CHUNKS))]


def batches_of(features: list[np.ndarray], groups: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    for low in range(0, len(groups), BATCH):
        yield [f[low : low + BATCH] for f in features], groups[low : low + BATCH]


def _counted(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Total count of each key, for every sender; values: count * GROUPS + group."""
    return np.repeat(np.add.reduceat(values // GROUPS, starts), np.diff(np.append(starts, len(values))))


def _vocabulary(values: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple:
    """Tokens and types of each group in a bucket."""
    counts, groups = np.add.reduceat(values // GROUPS, starts), values[starts] % GROUPS
    known = counts > 0
    return np.bincount(groups[known], counts[known], GROUPS), np.bincount(groups[known], minlength=GROUPS)


def for_sums(given: DataFrame) -> DataFrame:
    """The rows of a scan in fewer partitions: a task's sums take up to 19 MB of disk, however little it reads."""
    context = given.sparkSession.sparkContext
    return given.coalesce(max(2 * context.defaultParallelism, -(-scanned_bytes(given) // TASK_BYTES)))


def score_texts(docs: DataFrame, trains: Callable[[int | None], bool], id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    rounds: gradient updates; each but the first reads the training texts once more.
    """
    given = as_scan(docs, "documents", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = given.sparkSession

    def in_training(block: Block) -> np.ndarray:
        return np.fromiter((trains(i if k else None) for i, k in zip(block.ids.tolist(), block.known.tolist())), bool, len(block.ids))

    def token_keys(part: int, number: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
        t = Tokens(block)
        keys, first, number_of = np.unique(t.hashes, return_index=True, return_inverse=True)
        counts = np.bincount(number_of, np.repeat(in_training(block), np.diff(t.bounds)), len(keys)).astype(np.int64)
        return keys, counts * GROUPS + t.groups[first]

    counted = exchange(given, token_keys, _counted, "token-counts", wide=True, answer=np.int64, summarise=_vocabulary, block_bytes=BLOCK_BYTES)
    tokens, types = np.zeros(GROUPS), np.zeros(GROUPS)
    for n, v in summaries(counted):
        tokens, types = tokens + n, types + v
    total, distinct = int(tokens.sum()), int(types.sum())
    whole = total + 0.5 * (distinct + 1)
    mass = tokens + 0.5 * types
    unknown = 0.5 / whole
    model = Model(mass + 1e-9)

    def summed(batches: Iterator[pa.RecordBatch], start: Model | None) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, _, block in numbered(batches, BLOCK_BYTES):
            used = in_training(block)
            if not used.any():
                continue
            sums = sums or Sums()
            t = Tokens(block)
            of = np.repeat(used, np.diff(t.bounds))
            features, groups = [f[of] for f in t.features()], t.groups[of]
            if start is None:
                sums.observe(features, groups)
                continue
            for f, g in batches_of(features, groups):
                sums.expect(start, f, g)
        if sums:
            rows = sums.chunks()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "sums"])

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for x in group["sums"]:
            total = total + np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64)
        return pd.DataFrame({"chunk": [key[0]], "sums": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})

    def gathered(start: Model | None) -> list[np.ndarray]:
        """Sums over all tasks, first within NEAR tasks; their size doesn't grow with the input."""
        shared = spark.sparkContext.broadcast(pickle.dumps(start))
        form = "chunk int, sums binary"
        sent = for_sums(given).mapInArrow(lambda batches: summed(batches, pickle.loads(shared.value)), form)
        sums = sent.withColumn("near", F.floor(F.spark_partition_id() / NEAR)).groupBy("chunk", "near").applyInPandas(added, form).groupBy("chunk").applyInPandas(added, form)
        pieces = [np.frombuffer(zlib.decompress(r.sums), np.float32) for r in sorted(sums.collect(), key=lambda r: r.chunk)]  # CHUNKS rows
        shared.unpersist()
        return list(np.concatenate(pieces).astype(np.float64).reshape(FACTORS, FEATURES, ROWS, FAN))

    observed = gathered(None) if total and rounds else None
    for r in range(rounds if total else 0):
        model.move(observed, gathered(model) if r else None)
    del observed

    final = spark.sparkContext.broadcast(pickle.dumps(model))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, shared = None, pickle.loads(final.value)
        for part, number, block in numbered(batches, BLOCK_BYTES):
            answers = answers or Answers(counted, part, np.int64)
            t = Tokens(block)
            keys, number_of = np.unique(t.hashes, return_inverse=True)
            counts = answers.of(number, block, len(keys))[number_of]
            base = np.log10((counts + 0.5) / whole)
            known = counts > 0
            own = base.copy()
            if known.any():
                log_group = np.concatenate([shared.log_probability(f, g) for f, g in batches_of(t.features(), t.groups)]) / np.log(10)
                own += np.where(known, log_group + np.log10((1 - unknown) * whole) - np.log10(np.maximum(mass, 0.5))[t.groups], 0.0)
            begin = t.bounds[:-1]
            columns = [~in_training(block), np.diff(t.bounds), np.add.reduceat(known.astype(np.int64), begin), np.full(len(begin), total), np.add.reduceat(base, begin), np.add.reduceat(own, begin)]
            yield pa.RecordBatch.from_arrays([block.id_column(), *(pa.array(c, kind) for c, kind in zip(columns, schema.types[1:]))], schema=schema)

    return given.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def in_four_fifths(doc_id: int | None) -> bool:
    """Texts whose crc32 of the id as text leaves another remainder than 1 by 5; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1
