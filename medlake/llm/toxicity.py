"""Toxicity: a convolutional text classifier in numpy.

Words (ASCII letters lower-cased, digits, non-ASCII letters) are hashed into
two embedding tables whose rows are added, so that two words collide only if
both hashes do.  Filters of widths 1, 2 and 3 run over the whole text, their
largest activations are pooled, and a logistic layer gives the score.  Neither
id, language nor source is an input.

Training uses every labelled row but those whose crc32(id) mod 5 is 0, one row
for each id (of an id's documents the one with the smallest hash).  Remainder 1
is left out of the fit and calibrates: the score (a line through the logits) and
one decision threshold per language, shrunk to the common one where a language
has few labelled rows.  The other rows are dealt into shards of about
``SHARD_ROWS``, which tasks train side by side from a common model; after each of
``ROUNDS`` rounds every parameter moves by the mean over the shards that changed
it.  Word counts, calibration sums and threshold counts are Spark jobs over all
rows too; the driver holds one model (about 8 MB with its step sizes) and the
counts by language and score bin.  Documents without a label are passed over
before the join.  Scoring is one pass over all texts, slice by slice, with the
model (about 4 MB, fixed) broadcast.

Results for odd input: null and empty texts get the score of an empty text; a
null id is never held out; a null or unknown language uses the common
threshold; labels that are null are ignored, contradicting ones count as
toxic; without both labels every score is the share of toxic labels (0 if
there are none).  Extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import filter_bits, key_bitmap, key_hits, landed, lower_bytes, row_key, text_slices, word_bounds, word_hashes

SHARD_ROWS = 16000
ROUNDS = 4
BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 8
STEPS = 2000
MIN_DOCS = 3
DROP = 0.1
BATCH = 32
SHRINK = 200.0
#: Score bins a unit of the logit, and rows of a table that travel together.
BINS = 256
SEGMENT = 4096


def bucket_words(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets by row) for slices of the texts."""
    for lo, hi, data, offs in text_slices(arr):
        low = lower_bytes(data)
        starts, ends, row = word_bounds(low, offs, "alnum")
        yield lo, word_hashes(low, starts, ends), np.searchsorted(row, np.arange(hi - lo + 1))


@dataclass
class TextCnn:
    """Two hashed embedding tables, filters by width, one logistic unit."""
    seed: int = 7
    gain: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    steps: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.tables = [rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32) for _ in range(2)]
        self.filters = [rng.normal(0, 0.6, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offsets = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.full(1, -1.0, np.float32)

    def embed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = (words % np.uint64(BUCKETS)).astype(np.int64)
        j = ((words >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
        return i, j, self.tables[0][i] + self.tables[1][j]

    def convolve(self, emb: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Activations before pooling, one column per filter; a filter that
        reaches past its text's end sees zeros there."""
        out = np.empty((len(emb), len(WIDTHS) * FILTERS), np.float32)
        for k, f in enumerate(self.filters):
            acc = emb @ f[0]
            for d in range(1, len(f)):
                if len(emb) > d:
                    same = (row[d:] == row[:-d]).astype(np.float32)[:, None]
                    acc[:-d] += (emb[d:] @ f[d]) * same
            out[:, k * FILTERS:(k + 1) * FILTERS] = acc
        return out + self.offsets

    def pool(self, act: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Largest activation of each filter in each text, at least 0."""
        out = np.zeros((len(cut) - 1, act.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(cut) > 0)
        if len(full):
            out[full] = np.maximum(np.maximum.reduceat(act, cut[full], axis=0), 0)
        return out

    def logits(self, words: np.ndarray, cut: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        pooled = self.pool(self.convolve(self.embed(words)[2], row), cut)
        return (pooled @ self.out).astype(np.float64) + self.bias

    def score(self, words: np.ndarray, cut: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(cut) - 1, self.constant)
        return 1 / (1 + np.exp(-self.line(self.logits(words, cut))))

    def line(self, logit: np.ndarray) -> np.ndarray:
        return np.clip(self.gain * logit + self.shift, -30, 30)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.offsets, self.out, self.bias]

    def begin(self) -> None:
        """Adagrad's sums: of the two tables, then of the dense parameters."""
        self.steps = [np.full(x.shape, 1e-2, np.float32) for x in (*self.tables, *self.dense())]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> None:
        """Mini-batch gradient steps; pooling passes each gradient to the one
        position that won, so only those embedding rows change (Adagrad).
        Pooled features are dropped at random, so that no text is learned by heart.
        ``texts`` are codes of words."""
        rng = np.random.default_rng(seed)
        dense, g_table, g_dense = self.dense()[:-1], self.steps[:2], self.steps[2:-1]
        g_bias, lr = self.steps[-1], np.float32(0.08)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                pick = order[lo:lo + BATCH]
                cut = np.cumsum([0, *(len(texts[p]) for p in pick)])
                words = _words(np.concatenate([texts[p] for p in pick]))
                row = np.repeat(np.arange(len(pick)), np.diff(cut))
                i, j, emb = self.embed(words)
                act = self.convolve(emb, row)
                best = pooled = self.pool(act, cut)
                pooled = pooled * ((rng.random(pooled.shape) >= DROP) / (1 - DROP)).astype(np.float32)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
                d = ((p - y[pick]) / len(pick)).astype(np.float32)
                grads = [np.zeros_like(x) for x in dense]
                grads[-1][:] = pooled.T @ d + 1e-4 * self.out
                back = d[:, None] * self.out[None, :] * (pooled > 0) / (1 - DROP)
                grads[-2][:] = back.sum(axis=0)
                demb: list[tuple[np.ndarray, np.ndarray]] = []
                for c in range(act.shape[1]):
                    k, f = divmod(c, FILTERS)
                    live = np.flatnonzero(back[:, c])
                    if not len(live):
                        continue
                    won = np.flatnonzero(act[:, c] == best[row, c])
                    at = np.full(len(pick), -1)
                    at[row[won][::-1]] = won[::-1]
                    live = live[at[live] >= 0]
                    t, g = at[live], back[live, c]
                    for off in range(WIDTHS[k]):
                        ok = t + off < cut[live + 1]
                        grads[k][off, :, f] += g[ok] @ emb[t[ok] + off]
                        demb.append((t[ok] + off, g[ok][:, None] * self.filters[k][off, :, f][None, :]))
                for x, g, s in zip(dense, grads, g_dense, strict=True):
                    s += g * g
                    x -= lr * g / np.sqrt(s)
                g_bias += d.sum() ** 2
                self.bias -= lr * d.sum() / np.sqrt(g_bias)
                if demb:
                    pos = np.concatenate([x for x, _ in demb])
                    val = np.concatenate([x for _, x in demb])
                    for table, ids, s in ((self.tables[0], i, g_table[0]), (self.tables[1], j, g_table[1])):
                        rows, inv = np.unique(ids[pos], return_inverse=True)
                        g = np.zeros((len(rows), DIM), np.float32)
                        np.add.at(g, inv, val)
                        s[rows] += g * g
                        table[rows] -= lr * g / np.sqrt(s[rows])


@dataclass
class ToxicityModel:
    cnn: TextCnn
    common: float
    by_lang: dict[str, float]

    def threshold(self, lang: Column) -> Column:
        out = F.lit(self.common)
        for name, t in sorted(self.by_lang.items()):
            out = F.when(lang == name, F.lit(t)).otherwise(out)
        return out


def _coded(wanted):
    """Each word as its places in the two tables (16 bits each), for the rows whose id
    hits the bitmap.  The test is made here, as one of its own would keep a second Python
    worker for each running task, in every later stage as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(key_hits(wanted.value, batch.column("_id").to_numpy())))
            for lo, words, cut in bucket_words(batch.column("_text")):
                n, low = len(cut) - 1, np.uint64(BUCKETS - 1)
                codes = (words & low | (words >> np.uint64(32) & low) << np.uint64(16)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, n) for c in ("_id", "_lang", "_h")]
                    + [pa.array([codes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["_id", "_lang", "_h", "_codes"])
    return run


def _words(codes: np.ndarray) -> np.ndarray:
    """Word hashes with the places of the codes."""
    c = codes.astype(np.uint64)
    return c & np.uint64(BUCKETS - 1) | c >> np.uint64(16) << np.uint64(32)


def _code_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes with the number of a batch's texts they stand in."""
    for batch in batches:
        own = [np.unique(np.frombuffer(c, np.uint32)) for c in batch.column("_codes").to_pylist()]
        codes, n = np.unique(np.concatenate([np.empty(0, np.uint32), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


_MOVES = "chunk int, shard int, places binary, moves binary"


def _moves(shard: int, old: TextCnn, new: TextCnn) -> Iterator[tuple[int, int, bytes, bytes]]:
    """What a shard changed: rows of ``SEGMENT``-row chunks of the tables, parameters
    and step sums side by side, and last the dense parameters."""
    for t in (0, 1):
        moved = np.flatnonzero((new.steps[t] != old.steps[t]).any(axis=1))
        delta = np.hstack([new.tables[t][moved] - old.tables[t][moved], new.steps[t][moved] - old.steps[t][moved]])
        for k in range(BUCKETS // SEGMENT):
            lo, hi = np.searchsorted(moved, (k * SEGMENT, (k + 1) * SEGMENT))
            if hi > lo:
                yield t * (BUCKETS // SEGMENT) + k, shard, (moved[lo:hi] % SEGMENT).astype(np.int32).tobytes(), delta[lo:hi].tobytes()
    flat = [np.concatenate([x.ravel() for x in (*m.dense(), *m.steps[2:])]) for m in (old, new)]
    yield 2 * BUCKETS // SEGMENT, shard, np.arange(len(flat[0]), dtype=np.int32).tobytes(), (flat[1] - flat[0]).tobytes()


def _mean_moves(moves: pa.Table) -> pa.Table:
    """Of one chunk, the mean move of each place over the shards that moved it."""
    rows = sorted(zip(*(moves.column(c).to_pylist() for c in ("chunk", "shard", "places", "moves")), strict=True))
    total = times = None
    for _, _, at, delta in rows:
        places = np.frombuffer(at, np.int32)
        delta = np.frombuffer(delta, np.float32).reshape(len(places), -1)
        if total is None:
            total, times = np.zeros((max(SEGMENT, len(places)), delta.shape[1])), np.zeros(max(SEGMENT, len(places)))
        total[places] += delta
        times[places] += 1
    places = np.flatnonzero(times)
    mean = (total[places] / times[places, None]).astype(np.float32)
    return pa.table([pa.array([rows[0][0]], pa.int32()), pa.array([0], pa.int32()), pa.array([places.astype(np.int32).tobytes()]),
                     pa.array([mean.tobytes()])], names=["chunk", "shard", "places", "moves"])


def _apply(cnn: TextCnn, moves: list) -> None:
    for r in moves:
        places, delta = np.frombuffer(r["places"], np.int32), np.frombuffer(r["moves"], np.float32)
        t, k = divmod(r["chunk"], BUCKETS // SEGMENT)
        if t < 2:
            delta = delta.reshape(len(places), -1)
            cnn.tables[t][k * SEGMENT + places] += delta[:, :DIM]
            cnn.steps[t][k * SEGMENT + places] += delta[:, DIM:]
            continue
        at = 0
        for x in (*cnn.dense(), *cnn.steps[2:]):
            x += delta[at:at + x.size].reshape(x.shape)
            at += x.size


def _trainer(model, common, epochs: int, turn: int):
    """Train the rows of each shard (they come sorted by shard) from ``model``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(shard: int, texts: list[np.ndarray], y: list[int]) -> pa.RecordBatch:
            old, new = model.value, copy.deepcopy(model.value)
            new.fit(texts, np.array(y, np.float32), epochs, new.seed + 1 + turn * 1_000_003 + shard)
            cols = zip(*_moves(shard, old, new), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                              names=["chunk", "shard", "places", "moves"])

        now, texts, y = None, [], []
        for batch in batches:
            for shard, codes, label in zip(*(batch.column(c).to_pylist() for c in ("_shard", "_codes", "_y")), strict=True):
                if shard != now and texts:
                    yield one(now, texts, y)
                    texts, y = [], []
                now, own = shard, np.frombuffer(codes, np.uint32)
                texts.append(own[key_hits(common.value, own.astype(np.int64))])
                y.append(label)
        if texts:
            yield one(now, texts, y)
    return run


def _logits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_words(np.frombuffer(c, np.uint32)) for c in batch.column("_codes").to_pylist()]
            x = np.array([model.value.logits(w, np.array([0, len(w)]))[0] for w in own])
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_lang"), pa.array(x, pa.float64())], names=["_y", "_lang", "_x"])
    return run


def part(id_col: str) -> Column:
    """crc32 of the id as text, mod 5 (0: held out); null id: -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(-1)).cast("int")


def calibrate(cal: DataFrame, pos: int, neg: int) -> tuple[float, float]:
    """(gain, shift) of the line through the logits that fits the labels best
    (logistic regression by Newton steps, smoothed targets); each step sums over
    all rows, partition by partition."""
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)

    def sums(a: float, b: float) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(5)
            for batch in batches:
                x, t = batch.column("_x").to_numpy(), np.where(batch.column("_y").to_numpy() == 1, high, low)
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                g, h = p - t, p * (1 - p) + 1e-9
                out += ((h * x * x).sum(), (h * x).sum(), h.sum(), (g * x).sum(), g.sum())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=list("abcde"))
        rows = cal.select("_x", "_y").mapInArrow(run, "a double, b double, c double, d double, e double").collect()
        return [math.fsum(r[k] for r in rows) for k in range(5)]   # the same whatever the order of partitions

    a, b = 1.0, 0.0
    for _ in range(50):
        hxx, hx, h, gx, g = sums(a, b)
        step = np.linalg.solve(np.array([[hxx + 1e-6, hx], [hx, h + 1e-6]]), [gx, g])
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _binned(cnn: TextCnn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = cnn.line(batch.column("_x").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_lang"), pa.array(np.floor(z * BINS).astype(np.int32)),
                                              pa.array(1 / (1 + np.exp(-z)))], names=["_y", "_lang", "bin", "s"])
    return run


def _best_threshold(bins: list[tuple[int, int, int, float, float]]) -> float:
    """The cut between bins (number, toxic, others, least and largest score) with the
    best F1, half way between the scores beside it."""
    if not sum(b[1] for b in bins) or not sum(b[2] for b in bins):
        return 0.5
    bins = sorted(bins, reverse=True)
    tp, fp = np.cumsum([b[1] for b in bins]), np.cumsum([b[2] for b in bins])
    k = int(np.argmax(2 * tp / (tp + fp + tp[-1])))
    return float((bins[k][3] + (bins[k + 1][4] if k + 1 < len(bins) else 0.0)) / 2)


def _labelled(docs: DataFrame, lab: DataFrame, total: int, id_col: str, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """_id, _part, _y, _lang, _codes and _shard of every labelled id's document, written.

    There are more partitions than shards, so that few shards share one."""
    wanted = key_bitmap(lab.select("_id"), filter_bits(total))
    src = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       F.col(lang_col).cast("string").alias("_lang"))
           .filter("_id IS NOT NULL")
           .withColumn("_h", F.xxhash64("_text", "_lang")).mapInArrow(_coded(wanted), "_id long, _lang string, _h long, _codes binary"))
    one = src.join(lab, "_id").groupBy("_id", "_y", "_part").agg(F.min(F.struct("_h", "_codes", "_lang")).alias("m"))
    return landed(one.select("_id", "_y", "_part", "m._codes", "m._lang", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("_shard"))
                  .repartition(4 * shards, "_shard").sortWithinPartitions("_shard", "_id"), "toxicity-rows")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic", shard_rows: int = SHARD_ROWS) -> ToxicityModel:
    """Fit on all labelled rows that are not held out, in shards of about ``shard_rows``."""
    lab = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
           .withColumn("_part", part("_id")).filter("_part <> 0").withColumn("_id", F.col("_id").cast("long")))
    n = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    cnn = TextCnn()
    total = sum(n.values())
    if not n.get(0) or not n.get(1):
        cnn.constant = float(n.get(1, 0) / total) if total else 0.0
        return ToxicityModel(cnn, 0.5, {})
    rows = _labelled(docs, lab.filter("_y IN (0, 1)"), total, id_col, text_col, lang_col, -(-total // shard_rows))
    got = {(r["_cal"], r["_y"]): r["n"] for r in rows.groupBy((F.col("_part") == 1).alias("_cal"), "_y").agg(F.count("*").alias("n")).collect()}
    neg, pos = got.get((False, 0), 0), got.get((False, 1), 0)
    if not neg or not pos:
        cnn.constant = float(n[1] / total)
        return ToxicityModel(cnn, 0.5, {})
    sc, fit = docs.sparkSession.sparkContext, rows.filter("_part <> 1")
    frequent = landed(fit.select("_codes").mapInArrow(_code_counts, "code long, n long").groupBy("code")
                      .agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS).select("code"), "toxicity-words")
    common = key_bitmap(frequent, filter_bits(frequent.count()))
    shards = rows.select("_shard").distinct().count()
    turns = 1 if shards == 1 else ROUNDS
    epochs = max(EPOCHS, -(-STEPS // -(-(neg + pos) // (BATCH * shards))))
    cnn.begin()
    for turn in range(turns):
        model = sc.broadcast(cnn)
        moves = (fit.select("_shard", "_codes", "_y").mapInArrow(_trainer(model, common, -(-epochs // turns), turn), _MOVES)
                 .groupBy("chunk").applyInArrow(_mean_moves, _MOVES).collect())
        cnn = copy.deepcopy(cnn)
        _apply(cnn, moves)
        model.unpersist()
    cnn.steps = []
    seen = pos / neg
    pos, neg = got.get((True, 1), 0), got.get((True, 0), 0)
    if not pos + neg:
        cnn.shift = float(np.log(n[1] / n[0]) - np.log(seen))
        return ToxicityModel(cnn, 0.5, {})
    cal = landed(rows.filter("_part = 1").select("_y", "_lang", "_codes").mapInArrow(_logits(sc.broadcast(cnn)), "_y int, _lang string, _x double"),
                 "toxicity-logits")
    cnn = copy.deepcopy(cnn)
    cnn.gain, cnn.shift = calibrate(cal, pos, neg)
    line = TextCnn.__new__(TextCnn)
    line.gain, line.shift = cnn.gain, cnn.shift
    bins = (cal.mapInArrow(_binned(line), "_y int, _lang string, bin int, s double").groupBy("_lang", "bin")
            .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect())
    every, own = {}, {}
    for r in bins:
        b = (r["bin"], r["pos"], r["neg"], r["lo"], r["hi"])
        own.setdefault(r["_lang"] or "", []).append(b)
        e = every.get(r["bin"], (r["bin"], 0, 0, 1.0, 0.0))
        every[r["bin"]] = (r["bin"], e[1] + b[1], e[2] + b[2], min(e[3], b[3]), max(e[4], b[4]))
    threshold = _best_threshold([*every.values()])
    by = {}
    for name in sorted(set(own) - {""}):
        m = sum(b[1] + b[2] for b in own[name])
        by[name] = float((m * _best_threshold(own[name]) + SHRINK * threshold) / (m + SHRINK))
    return ToxicityModel(cnn, threshold, by)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = model.value
        for batch in batches:
            for lo, words, cut in bucket_words(batch.column("_text")):
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_rk").slice(lo, n), batch.column("_id").slice(lo, n), batch.column("_lang").slice(lo, n),
                     pa.array(cnn.score(words, cut), pa.float64())], names=["_rk", "_id", "_lang", "score"])
    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """Per row: _rk, _id, score, threshold (of its language), rejected."""
    src = docs.select(row_key(id_col, text_col).alias("_rk"), F.col(id_col).cast("long").alias("_id"),
                      F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model.cnn)
    out = src.mapInArrow(_scorer(shared), "_rk long, _id long, _lang string, score double")
    return (out.withColumn("threshold", model.threshold(F.col("_lang")))
            .withColumn("rejected", F.col("score") >= F.col("threshold")))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs, model).select(
        F.col("_id").alias("doc_id"), (part("_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The documents below their language's threshold, all columns kept.

    The decision rides along with the rows (mapInArrow over all columns), so
    no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = np.empty(batch.num_rows, bool)
            cut = np.array([m.by_lang.get(x, m.common) for x in batch.column(lang).to_pylist()])
            for lo, words, rows in bucket_words(batch.column(at).cast(pa.string())):
                n = len(rows) - 1
                keep[lo:lo + n] = m.cnn.score(words, rows) < cut[lo:lo + n]
            yield batch.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)
