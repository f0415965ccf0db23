"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hashed form and of two hashed prefixes.
Filters over one, two and three words, the maximum over a text, and a logistic layer give the
score.  The network learns from every labelled row.  Which buckets get an embedding is told by counts
over all rows that train; those rows then lie encoded in the shared folder, dealt by a hash of the id to
replicas of about ``REPLICA_ROWS`` rows.  In each of ``ROUNDS`` rounds every replica goes on from the shared
network over all its rows (numpy: Adagrad on the log loss, gradients through the pooled positions only), and
an aggregate takes the mean of every parameter over the replicas that moved it.  One fifth of the labelled rows
is kept out of training; on all of these the score is scaled to a probability and each language gets a
threshold: the smallest with a precision of ``PRECISION``.  Scoring is one pass without a shuffle; the
model has at most ``BUCKETS`` rows, which is all that the driver and a broadcast hold.

Scores depend on the text alone; labels, languages, sources and ids are no inputs.  Null and empty
texts score as a text without words; whole texts are scored; repeated rows score alike; several
labels of one id count as toxic if one is; without labels of both kinds every score is the share
of toxic labels (0 without labels); extra columns are ignored by ``score`` and kept by ``rejecting``.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import dropped, shared_dir, written
from graphloom.llm.counts import texts_of
from graphloom.llm.words import NON_SPACE, Words, hash_ranges, mix, split

BUCKETS = 1 << 20
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
PREFIXES = (5, 7)
STEPS, BATCH, RATE = 1200, 48, 0.05
#: Rows of a replica, and, where there are several, rounds and passes over the rows in each; a single replica takes ``STEPS`` steps, or more to meet each row.
REPLICA_ROWS, ROUNDS, PASSES = 4000, 4, 1
#: Steps of a logit within which the rows kept out are added up, and the largest logit told apart.
BINS, FAR = 256, 64
#: Bits of the map of labelled ids that documents meet before they are shuffled, in pieces of Spark's bitmap size.
MAP_BITS, PIECE_BITS = 1 << 25, 1 << 15
PRECISION = 0.9
DEFAULT_THRESHOLD = 0.7
CHUNK_BYTES = 1 << 20
#: Bytes that end a word without belonging to it, for the hashed form.
EDGE = b".,;:!?\"'()[]{}*#$%&|-"


@dataclass
class Net:
    """Embedding rows (0: none), their bucket numbers, filters by width, the logistic layer, scaling and thresholds."""

    buckets: np.ndarray
    rows: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _forms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket numbers (form, prefixes; -1 where a word is shorter) of each distinct word, and each word's distinct number."""
    if not len(words.hashes):
        return np.empty((0, 1 + len(PREFIXES)), np.int64), np.empty(0, np.int64)
    _, where, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw = np.frombuffer(words.buffer, np.uint8)
    edge = np.zeros(256, bool)
    edge[list(EDGE)] = True
    starts, ends = words.starts[where].copy(), words.ends[where].copy()
    for _ in range(4):  # strip up to four marks at either end
        starts += (starts < ends) & edge[raw[np.minimum(starts, len(raw) - 1)]]
        ends -= (starts < ends) & edge[raw[np.maximum(ends - 1, 0)]]
    columns = [hash_ranges(words.buffer, starts, ends)]
    for k, n in enumerate(PREFIXES):
        columns.append(np.where(ends - starts >= n, mix(hash_ranges(words.buffer, starts, np.minimum(ends, starts + n)) + np.uint64(k + 1)), 0))
    out = np.stack([(c % np.uint64(BUCKETS)).astype(np.int64) for c in columns], axis=1)
    out[starts >= ends] = -1
    for k, n in enumerate(PREFIXES):
        out[ends - starts < n, k + 1] = -1
    return out, number


def _row_numbers(buckets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The embedding row (from 1; 0: none) of each bucket number."""
    if not len(known):
        return np.zeros(buckets.shape, np.int64)
    at = np.minimum(np.searchsorted(known, buckets), len(known) - 1)
    return np.where(known[at] == buckets, at + 1, 0)


def _pooled(vectors: np.ndarray, first: np.ndarray, net: Net) -> np.ndarray:
    """The maximum of every filter over each text, at least 0."""
    n = len(first) - 1
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        m = len(vectors) - width + 1
        if m <= 0:
            continue
        z = np.repeat(net.shifts[k][None, :], m, 0)
        for j in range(width):
            z += vectors[j : j + m] @ net.filters[k][j]
        long = np.flatnonzero(np.diff(first) >= width)
        if not len(long):
            continue
        bounds = np.stack((first[long], first[long + 1] - width + 1), 1).ravel()
        bounds = bounds[:-1] if bounds[-1] >= m else bounds
        top = np.maximum.reduceat(z, bounds, axis=0)[0::2]
        out[long, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
    return out


def logits(texts: list[bytes], net: Net) -> np.ndarray:
    out = np.zeros(len(texts))
    for begin, end in _chunks(texts):
        words = split(texts[begin:end], NON_SPACE)
        forms, number = _forms(words)
        vectors = net.rows[_row_numbers(forms, net.buckets)].sum(1)[number] if len(number) else np.empty((0, DIM), np.float32)
        out[begin:end] = _pooled(vectors, words.first, net) @ net.out + net.bias
    return out


def scores(texts: list[bytes], net: Net) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale * logits(texts, net) + net.offset, -30, 30)))


def _constant(share: float) -> Net:
    odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    zero = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    return Net(np.empty(0, np.int64), np.zeros((1, DIM), np.float32), zero, [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS)), 0.0, 1.0, float(odds))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def _count(texts: list[bytes], toxic: np.ndarray, seen: np.ndarray) -> None:
    """Adds to seen[label] in how many texts of the label each bucket occurs."""
    for begin, end in _chunks(texts):
        words = split(texts[begin:end], NON_SPACE)
        forms, number = _forms(words)
        owner, label = words.owner(), toxic[begin:end]
        for column in range(forms.shape[1]):
            b = forms[number, column]
            pairs = np.unique(owner[b >= 0] * np.int64(BUCKETS) + b[b >= 0])
            for k in (0, 1):
                np.add.at(seen[k], pairs[label[pairs // BUCKETS] == k] % BUCKETS, 1)


def _encoded(texts: list[bytes], known: np.ndarray) -> Iterator[np.ndarray]:
    """The embedding rows of each word of each text.  Of words without any, at most as many in a row as the widest filter sees stay: the maxima are the same."""
    for begin, end in _chunks(texts):
        words = split(texts[begin:end], NON_SPACE)
        forms, number = _forms(words)
        rows = _row_numbers(forms, known).astype(np.int32)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            own = rows[number[a:b]]
            none = ~own.any(axis=1)
            drop = none.copy()
            for j in range(1, max(WIDTHS) + 1):
                drop[:j] = False
                drop[j:] &= none[: max(0, len(none) - j)]
            yield own[~drop]


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray]]:
    """The replica and documents of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch["replica"][k].as_py(), batch["docs"][k].values


def _decoded(docs: pa.StructArray) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in docs.field("words").to_pylist()]


def _start(buckets: np.ndarray, z: np.ndarray, rate: float, seed: int = 5) -> tuple[Net, Net]:
    """The network that training begins with, and the sums of squared gradients in the same form."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((len(buckets) + 1, DIM), np.float32)
    rows[1:] = rng.normal(0, 0.02, (len(buckets), DIM))
    rows[1:, 0] = np.clip((z - 2.5) / 4, -0.2, 1.5)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1.0
    net = Net(buckets, rows, filters, [np.full(FILTERS, -0.05, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)), float(np.log(rate / (1 - rate))))
    net.out[0::FILTERS] = 1.0
    square = Net(buckets, np.full(rows.shape, 1e-2, np.float32), [np.full(f.shape, 1e-2, np.float32) for f in filters], [np.full(FILTERS, 1e-2, np.float32) for _ in WIDTHS], np.full(net.out.shape, 1e-2), 1e-2)
    return net, square


def _packed(net: Net) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM."""
    flat = np.concatenate([x.ravel() for x in (*net.filters, *net.shifts, net.out)] + [[net.bias]])
    return np.concatenate((flat, np.zeros(-len(flat) % DIM))).reshape(-1, DIM)


def _unpack(net: Net, packed: np.ndarray) -> None:
    at, flat = 0, packed.ravel()
    for part in (*net.filters, *net.shifts, net.out):
        part[...] = flat[at : at + part.size].reshape(part.shape)
        at += part.size
    net.bias = float(flat[at])


def descend(net: Net, square: Net, docs: list[np.ndarray], y: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Moves net by Adagrad; every row is met about equally often.  Returns the embedding rows that moved."""
    rng = np.random.default_rng(seed)
    moved = np.zeros(len(net.rows), bool)

    def move(value, grad, total):
        total += grad * grad
        value -= RATE * grad / np.sqrt(total)

    size = min(BATCH, len(docs))
    turns = np.concatenate([rng.permutation(len(docs)) for _ in range(-(-steps * size // len(docs)))])
    for turn in range(steps):
        pick = turns[turn * size : (turn + 1) * size]
        used = np.concatenate([docs[k] for k in pick])
        first = np.concatenate(([0], np.cumsum([len(docs[k]) for k in pick])))
        x = net.rows[used].sum(1)
        pooled = np.zeros((len(pick), FILTERS * len(WIDTHS)))
        best = np.full(pooled.shape, -1, np.int64)
        for k, width in enumerate(WIDTHS):
            m = len(x) - width + 1
            if m <= 0:
                continue
            zed = np.repeat(net.shifts[k][None, :], m, 0)
            for j in range(width):
                zed += x[j : j + m] @ net.filters[k][j]
            for d in range(len(pick)):
                a, b = first[d], first[d + 1] - width + 1
                if b > a:
                    top = zed[a:b].argmax(0)
                    value = zed[a:b][top, np.arange(FILTERS)]
                    at = slice(k * FILTERS, (k + 1) * FILTERS)
                    pooled[d, at] = np.maximum(value, 0)
                    best[d, at] = np.where(value > 0, top + a, -1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
        g = (p - y[pick]) / len(pick)
        back = g[:, None] * net.out[None, :] * (best >= 0)
        touched, inverse = np.unique(used, return_inverse=True)
        inverse = inverse.reshape(used.shape)
        grad_rows = np.zeros((len(touched), DIM), np.float32)
        for k, width in enumerate(WIDTHS):
            d, f = np.nonzero(best[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at, value = best[d, k * FILTERS + f], back[d, k * FILTERS + f].astype(np.float32)
            grad_f = np.zeros_like(net.filters[k])
            for j in range(width):
                np.add.at(grad_f[j].T, f, value[:, None] * x[at + j])
                step = value[:, None] * net.filters[k][j][:, f].T
                for c in range(used.shape[1]):
                    np.add.at(grad_rows, inverse[at + j, c], step)
            move(net.filters[k], grad_f, square.filters[k])
            grad_s = np.zeros(FILTERS, np.float32)
            np.add.at(grad_s, f, value)
            move(net.shifts[k], grad_s, square.shifts[k])
        grad_rows[touched == 0] = 0
        some = np.abs(grad_rows).sum(1) > 0
        touched, grad_rows = touched[some], grad_rows[some]
        part, total = net.rows[touched], square.rows[touched]
        move(part, grad_rows, total)
        net.rows[touched], square.rows[touched] = part, total
        moved[touched] = True
        move(net.out, pooled.T @ g + 1e-4 * net.out, square.out)
        square.bias += g.sum() ** 2
        net.bias -= RATE * g.sum() / np.sqrt(square.bias)
    return np.flatnonzero(moved)


def _scaled(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Factor and offset that make logits x, of n rows each, probabilities of toxic ones."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = n * p - toxic, n * p * (1 - p) + 1e-6
        grad = np.array([(r * x).sum() + 1e-2 * (a - 1), r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = max(0.05, a - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -2, 2))
    return a, b


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _maybe_in(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id's hash occurs in marked: a map of MAP_BITS bits (4 MB) is broadcast, so hardly any other text is shuffled."""
    kind = docs.schema["doc_id"].dataType
    at = F.pmod(F.xxhash64(F.col("doc_id").cast(kind)), F.lit(MAP_BITS))
    bits = marked.select(at.alias("at")).groupBy(F.floor(F.col("at") / PIECE_BITS).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE_BITS).alias("bits"))
    met = docs.withColumn("at", at).join(F.broadcast(bits), F.floor(F.col("at") / PIECE_BITS) == F.col("piece"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") % PIECE_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.col("at") % 8)), F.lit(2)) == 1).select(docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Learn from all labelled rows that are not held out; of rows with one id, from one text.  Its tables are deleted when it has learned."""
    where = shared_dir(docs.sparkSession)
    try:
        return _fitted(docs, labels, where)
    finally:
        dropped(docs.sparkSession, where)


def _fitted(docs: DataFrame, labels: DataFrame, where: str) -> Net:
    spark = docs.sparkSession
    learns = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marked = labels.where(learns & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text = docs.where(learns).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = _maybe_in(text, marked).join(marked, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "toxic")).alias("r"))
    place = lambda k: F.xxhash64("doc_id", F.lit(k))
    rows = written(rows.select(place(0).alias("h"), "r.text", "r.lang", "r.toxic", (F.pmod(place(1), F.lit(5)) == 0).alias("out")), f"{where}/rows")
    n = {(r["out"], r["toxic"]): r["count"] for r in rows.groupBy("out", "toxic").count().collect()}
    total = sum(n.values())
    share = sum(v for k, v in n.items() if k[1]) / max(1, total)
    if not 0 < share < 1:
        return _constant(share)
    apart = total >= 50 and all(n.get((False, v)) for v in (0, 1))  # else all rows train and scale
    own = rows.where("not out") if apart else rows
    size = [sum(n.get((out, v), 0) for out in ((False,) if apart else (False, True))) for v in (0, 1)]
    rate = size[1] / sum(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            begin = 0
            for texts in texts_of(batch["text"], CHUNK_BYTES):
                _count(texts, batch["toxic"].to_numpy()[begin : begin + len(texts)], seen)
                begin += len(texts)
        b = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(seen[0, b]), pa.array(seen[1, b])], names=["b", "n0", "n1"])

    sums = own.mapInArrow(count, "b bigint, n0 bigint, n1 bigint").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    both = F.col("n0") + F.col("n1")
    # How much more often than expected a bucket occurs in toxic rows, in deviations: from 1.5 on, it gets a row.
    kept = sums.select("b", ((F.col("n1") - rate * both) / F.sqrt(rate * (1 - rate) * both + 1)).alias("z")).where("abs(z) >= 1.5").toArrow()
    order = np.argsort(kept["b"].to_numpy())
    known, z = kept["b"].to_numpy()[order], kept["z"].to_numpy()[order]
    net, square = _start(known, z * min(1.0, np.sqrt(REPLICA_ROWS / sum(size))), rate)
    replicas = max(1, sum(size) // REPLICA_ROWS)
    sent = spark.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["h", "lang", "toxic", "out"]).append_column("words", pa.array([zlib.compress(x.tobytes(), 1) for texts in texts_of(batch["text"], CHUNK_BYTES) for x in _encoded(texts, sent.value)], pa.binary()))

    data = rows.mapInArrow(encode, "h bigint, lang string, toxic int, out boolean, words binary")
    # A row a replica and kind, so that no round shuffles texts.
    data = data.withColumn("replica", F.pmod(F.xxhash64("h"), F.lit(replicas))).repartition(2 * replicas, "out", "replica")
    data = written(data.groupBy("out", "replica").agg(F.sort_array(F.collect_list(F.struct("h", "toxic", "words", "lang"))).alias("docs")), f"{where}/encoded")
    dropped(spark, f"{where}/rows")
    dealt = data.where("not out") if apart else data.groupBy("replica").agg(F.sort_array(F.flatten(F.collect_list("docs"))).alias("docs"))
    values, squares = [f"v{k}" for k in range(DIM)], [f"q{k}" for k in range(DIM)]
    schema = "at bigint, " + ", ".join(f"{c} double" for c in values + squares)

    def learner(turn: int, state):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for replica, docs in _replicas(batches):
                mine, total = pickle.loads(pickle.dumps(state.value))
                texts, toxic = _decoded(docs), docs.field("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
                steps = -(-PASSES * len(texts) // BATCH) if replicas > 1 else max(STEPS, -(-len(texts) // BATCH))
                moved = descend(mine, total, texts, toxic, steps, turn * 1_000_003 + replica)
                rest = _packed(mine), _packed(total)
                at = np.concatenate((moved, -1 - np.arange(len(rest[0]))))
                both = np.concatenate((np.concatenate((mine.rows[moved], rest[0])), np.concatenate((total.rows[moved], rest[1]))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c.astype(np.float64)) for c in both.T)], names=["at", *values, *squares])

        return learn

    for turn in range(ROUNDS if replicas > 1 else 1):
        state = spark.sparkContext.broadcast((net, square))
        mean = dealt.select("replica", "docs").mapInArrow(learner(turn, state), schema).groupBy("at").agg(*(F.avg(c).cast("float").alias(c) for c in values + squares)).toArrow()
        at = mean["at"].to_numpy()
        for model, names in ((net, values), (square, squares)):
            new = np.stack([mean[c].to_numpy() for c in names], axis=1)
            model.rows[at[at >= 0]] = new[at >= 0]
            _unpack(model, new[at < 0][np.argsort(-at[at < 0])])
    _calibrate(net, data.where("out").select("replica", "docs") if apart else dealt.select("replica", "docs"))
    return net


def _calibrate(net: Net, data: DataFrame) -> None:
    """Scale the logits on all rows kept out of training, then choose a threshold a language; rows are added up by steps of 1 / BINS of a logit."""
    sent = data.sparkSession.sparkContext.broadcast(net)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _replicas(batches):
            texts = _decoded(docs)
            x = np.zeros(len(texts))
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                x[a : a + 256] = _pooled(sent.value.rows[np.concatenate(some)].sum(1), np.concatenate(([0], np.cumsum([len(t) for t in some]))), sent.value) @ sent.value.out + sent.value.bias
            yield pa.RecordBatch.from_arrays([docs.field("lang"), docs.field("toxic"), pa.array(np.floor(np.clip(x, -FAR, FAR) * BINS).astype(np.int64))], names=["lang", "toxic", "bin"])

    bins = data.mapInArrow(weigh, "lang string, toxic int, bin bigint").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).persist()
    whole = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).orderBy("bin").toArrow()
    a, b = _scaled((whole["bin"].to_numpy() + 0.5) / BINS, whole["n"].to_numpy(), whole["toxic"].to_numpy())
    net.scale, net.offset = a, b

    def threshold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "descending")])
        hit, of = np.cumsum(table["toxic"].to_numpy()), np.cumsum(table["n"].to_numpy())
        good = np.flatnonzero(hit / of >= PRECISION)
        edge = 1 / (1 + np.exp(-np.clip(a * table["bin"].to_numpy()[good[-1]] / BINS + b, -30, 30))) if len(good) else 0.95
        some = [float(np.clip(edge, 0.3, 0.95))] if hit[-1] >= 10 else []
        return pa.table({"lang": pa.array(table["lang"].to_pylist()[:1][: len(some)], pa.string()), "least": pa.array(some, pa.float64())})

    net.thresholds = {r["lang"]: r["least"] for r in bins.groupBy("lang").applyInArrow(threshold, "lang string, least double").collect()}
    bins.unpersist()


def _score(docs: DataFrame, net: Net) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(scores(x, sent.value) for x in texts_of(text, CHUNK_BYTES))]), pa.float64())

    return scored(F.col("text").cast("string"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and whether the language's own threshold flags it."""
    net = fit(docs, labels)
    out = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), _score(docs, net).alias("_score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"), _flag(net).alias("flagged"))


def _flag(net: Net, name: str = "_score") -> Column:
    """A null language has the default threshold."""
    limit = F.lit(DEFAULT_THRESHOLD)
    for lang, value in sorted(net.thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return F.col(name) >= limit


def rejecting(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic by their language's threshold, with all their columns."""
    net = fit(docs, labels)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, _score(docs, net)).where(~_flag(net, name)).drop(name)
