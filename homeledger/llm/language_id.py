"""Language identification by a linear-chain conditional random field over the words of a text.

Words are runs of letters and marks. A word's emission is the sum of weights of its features: prefixes
and suffixes of up to AFFIX bytes, character 2- and 3-grams, its lexicon entry (the word itself) and its
capitalisation, all hashed into at most 2**BITS rows, fewer for many labels, so that the model has at most WEIGHTS numbers (16 MB)
beside its transition matrix, which is learned with them. Training maximises
the conditional likelihood by forward-backward and Adagrad over a bounded sample of labelled documents.
Each word of a training document carries the document's label; a share of the training sequences is spliced
from documents of two labels, so that transitions learn to switch. Prediction runs forward-backward over
every word of every text: word marginals label words, and their letter-weighted mean labels the document.

The sample takes up to SAMPLE_DOCS documents of each label by the hash of doc_id, SAMPLE_BYTES in equal shares (the
documented bound of the fit; a label whose first text is longer than its share gives that text's first words);
everything else covers all rows and whole texts. Every label is learned. Text, not lang, source or doc_id, is the input of a prediction.

Null text or no letter: `und`, score 0, as are all texts if there is nothing to learn from. Repeated rows
keep one output row each. A null doc_id counts as the empty text for the held-out rule. No rows: no rows. Very long
texts are a block of their own. Columns of docs travel; those named lang_pred and lang_score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Slices, blocks, prepare, runs, spans_of, table, text_bytes, word_hashes

SAMPLE_DOCS, SAMPLE_BYTES = 300, 6_000_000
#: Text bytes that are labelled at a time: features and emissions take a hundred times as many.
BLOCK_TEXT = 1 << 20
#: Numbers of a model at most.
WEIGHTS = 1 << 22
BITS, AFFIX, EPOCHS, RATE, SEED = 18, 4, 3, 0.3, 7
#: Words in one training batch.
BATCH_WORDS = 6_000
UND = "und"


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = True
    table[0x80:] = True
    return table


_LETTER = _letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and each word's row.

    ASCII letters are lower-cased. Bytes above 127 count as letters here, but a text without any letter
    is never given to the field.
    """
    data, offs = text_bytes(column)
    starts, ends = runs(_LETTER[data], offs)
    return data, starts, ends, np.searchsorted(offs, starts, "right") - 1


def bits_for(labels: int) -> int:
    """Bits of feature numbers for so many labels."""
    return max(4, min(BITS, (WEIGHTS // max(1, labels)).bit_length() - 1))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words one after another, and how many each word has; only these words' bytes are hashed."""
    upper, size = (data[starts] >= 65) & (data[starts] <= 90), ends - starts
    data = _LOWER[data[spans_of(size, starts)]]
    ends = np.cumsum(size)
    starts, cut = ends - size, Slices(data)
    mask = np.uint64((1 << bits) - 1)
    kinds = []
    slot = lambda h, kind: ((h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask).astype(np.int32)
    kinds.append(slot(cut.hashes(starts, ends), 1))
    kinds.append(np.where(upper, 1, 0).astype(np.int32))
    for n in range(1, AFFIX + 1):
        kinds.append(slot(cut.hashes(starts, np.minimum(starts + n, ends)), 10 + n))
        kinds.append(slot(cut.hashes(np.maximum(ends - n, starts), ends), 20 + n))
    fixed = np.stack(kinds, 1)
    counts = np.full(len(starts), fixed.shape[1], np.int64)
    grams = []
    for n in (2, 3):
        many = np.maximum(size - n + 1, 0)
        at = spans_of(many, starts)
        grams.append((many, slot(cut.hashes(at, at + n), 30 + n)))
        counts += many
    out = np.empty(int(counts.sum()), np.int32)
    base = np.cumsum(counts) - counts
    out[(base[:, None] + np.arange(fixed.shape[1])).ravel()] = fixed.ravel()
    base = base + fixed.shape[1]
    for many, ids in grams:
        out[spans_of(many, base)] = ids
        base = base + many
    return out, counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; every group has a row."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, values.shape[1]))


def forward_backward(e: np.ndarray, trans: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Word marginals, expected transitions and log likelihood's partition sum of many sequences.

    e: log emissions of the words of all sequences one after another. All sequences advance in step;
    sorted by length, those that still run are a prefix.
    """
    n, k = e.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), 0.0
    order = np.argsort(-lens, kind="stable")
    lens_d, first = lens[order], (np.cumsum(lens) - lens)[order]
    alive = np.searchsorted(-lens_d, -np.arange(1, int(lens_d[0]) + 1), "right")
    top = e.max(axis=1, keepdims=True)
    p = np.exp(e - top)
    m = np.exp(trans)
    alpha, scale = np.empty_like(p), np.empty(n)
    a = None
    for t, live in enumerate(alive.tolist()):
        at = first[:live] + t
        a = p[at] if t == 0 else (a[:live] @ m) * p[at]
        s = a.sum(axis=1, keepdims=True)
        a = a / s
        alpha[at], scale[at] = a, s[:, 0]
    beta, b, pairs = np.empty_like(p), np.ones((0, k)), np.zeros((k, k))
    for t in range(len(alive) - 1, -1, -1):
        live = alive[t]
        at = first[:live] + t
        if len(b) < live:
            b = np.concatenate([b, np.ones((live - len(b), k))])
        beta[at] = b
        if t:
            w = p[at] * b / scale[at][:, None]
            pairs += alpha[at - 1].T @ w
            b = w @ m.T
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    return marginal, pairs * m, float(np.log(scale).sum() + top.sum())


class Model:
    """Labels, emission weights by feature, and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans
        self.bits = len(weights).bit_length() - 1

    def emissions(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sums(self.weights[ids], counts).astype(np.float64)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
        """rows: (text, label)."""
        labels = sorted({y for _, y in rows})
        k, rng = len(labels), np.random.default_rng(SEED)
        bits = bits_for(k)
        weights, trans = np.zeros((1 << bits, k), np.float32), np.zeros((k, k))
        g_w, g_t = np.full((1 << bits, k), 1e-2, np.float32), np.full((k, k), 1e-2)
        data, starts, ends, row = words(pa.array([x for x, _ in rows], pa.large_string()))
        y = np.array([labels.index(v) for _, v in rows], np.int64)[row] if len(rows) else np.zeros(0, np.int64)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        for _ in range(epochs):
            # sequences: pieces of documents; every third is continued by a piece of another document
            pieces = [np.arange(a, min(a + 200, cuts[d + 1])) for d in range(len(rows)) for a in range(cuts[d], cuts[d + 1], 200)]
            pieces = [pieces[i] for i in rng.permutation(len(pieces))]
            seqs, i = [], 0
            while i < len(pieces):
                two = i % 3 == 0 and i + 1 < len(pieces)
                seqs.append(np.concatenate([pieces[i][:60], pieces[i + 1][:60]]) if two else pieces[i])
                i += 1
            lo = 0
            while lo < len(seqs):
                hi, size = lo, 0
                while hi < len(seqs) and size < BATCH_WORDS:
                    size += len(seqs[hi])
                    hi += 1
                at, lens = np.concatenate(seqs[lo:hi]), np.array([len(s) for s in seqs[lo:hi]])
                ids, counts = features(data, starts[at], ends[at], bits)
                marginal, pairs, _ = forward_backward(_sums(weights[ids], counts).astype(np.float64), trans, lens)
                truth = y[at]
                grad = -marginal
                grad[np.arange(len(at)), truth] += 1
                same = np.ones(len(at), bool)
                same[np.cumsum(lens)[:-1]] = same[0] = False
                seen = np.zeros((k, k))
                np.add.at(seen, (truth[:-1][same[1:]], truth[1:][same[1:]]), 1)
                per = np.repeat(grad.astype(np.float32), counts, axis=0)
                step = np.stack([np.bincount(ids, per[:, j], 1 << bits) for j in range(k)], 1).astype(np.float32) / len(at) * 100
                g_w += step * step
                weights += np.float32(RATE) * step / np.sqrt(g_w)
                t = (seen - pairs) / len(at) * 100
                g_t += t * t
                trans += RATE * t / np.sqrt(g_t)
                lo = hi
        return cls(labels, weights, trans)


def _grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    return first, inverse


def marginals(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word marginals, word starts and ends in the block's bytes, and rows, for every word of a block."""
    data, starts, ends, row = words(column)
    if not len(starts):
        return np.zeros((0, len(model.labels))), starts, ends, row
    upper = ((data[starts] >= 65) & (data[starts] <= 90)).astype(np.uint64)
    first, inverse = _grouped(word_hashes(data, starts, ends) ^ upper)
    e = model.emissions(*features(data, starts[first], ends[first], model.bits))[inverse]
    cut = np.searchsorted(row, np.arange(len(column) + 1))
    return forward_backward(e, model.trans, np.diff(cut))[0], starts, ends, row


def document_scores(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    """Label and score of each text; a word counts by its letters' bytes."""
    marginal, starts, ends, row = marginals(model, column)
    weight = (ends - starts).astype(np.float64)
    sums = np.stack([np.bincount(row, marginal[:, j] * weight, len(column)) for j in range(marginal.shape[1])], 1)
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    score = np.where(total > 0, sums[np.arange(len(column)), best] / np.maximum(total, 1e-300), 0.0)
    ok = [total[i] > 0 and has_letter(t) for i, t in enumerate(column.to_pylist())]
    return [model.labels[b] if o else UND for b, o in zip(best.tolist(), ok, strict=True)], [min(1.0, s) if o else 0.0 for s, o in zip(score.tolist(), ok, strict=True)]


def word_spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs of words of one language in a text, as byte offsets: what code-switched text is made of."""
    marginal, starts, ends, _ = marginals(model, pa.array([text], pa.large_string()))
    out: list[tuple[int, int, str]] = []
    for s, e, b in zip(starts.tolist(), ends.tolist(), marginal.argmax(axis=1).tolist(), strict=True):
        if out and out[-1][2] == model.labels[b]:
            out[-1] = (out[-1][0], e, out[-1][2])
        else:
            out.append((s, e, model.labels[b]))
    return out


HELD_OUT = "pmod(crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)), 5) = 0"


def training_rows(docs: DataFrame, per_label: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(text, lang) of a bounded sample of the labelled documents that are not held out, by hash of doc_id.

    Whole texts are taken as far as a label's equal share of sample_bytes goes; of a label without any such text, the
    first words of its first one.
    """
    use = docs.where(f"NOT ({HELD_OUT}) AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    order = F.xxhash64("doc_id", F.lit(SEED))
    seen = use.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    rows: list[tuple[str, str]] = []
    if not seen:
        return rows
    # a hash bound that about twice the sample falls under, then the least hashes: one scan, no sort of the corpus
    part = lambda n: min(1.0, (2.0 * per_label + 100.0) / n)
    share = max(1, sample_bytes // len(seen))
    bounds = docs.sparkSession.createDataFrame([(r.lang, min((1 << 63) - 1, -(1 << 63) + int(part(r.n) * (1 << 64)))) for r in seen], "lang string, bound long")
    few = use.select("lang", "doc_id", order.alias("h"), F.octet_length("text").alias("bytes"), "text").join(F.broadcast(bounds), "lang").where("h <= bound")
    own = Window.partitionBy("lang").orderBy("h", "doc_id", "bytes", "text")
    few = few.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= per_label)
    fits = F.when(F.col("bytes") <= share, F.col("bytes")).otherwise(0)
    few = few.withColumn("upto", F.sum(fits).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = few.where(f"bytes <= {share} AND upto <= {share}").select("lang", "nth", "text")
    lost = few.groupBy("lang").agg(F.min_by(F.substring("text", 1, share), "nth").alias("text"), F.min("bytes").alias("least")).where(f"least > {share}")
    lost = lost.select("lang", F.lit(0).alias("nth"), F.when(F.contains(F.rtrim("text"), F.lit(" ")), F.regexp_replace("text", "\\s\\S*$", "")).otherwise(F.col("text")).alias("text"))
    for x in whole.unionByName(lost).orderBy("lang", "nth").select("text", "lang").toLocalIterator():
        rows.append((x.text, x.lang))
    return rows


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in blocks(batches, "text", BLOCK_TEXT):
            if own.labels:
                lang, score = document_scores(own, batch.column("text"))
            else:
                lang, score = [UND] * batch.num_rows, [0.0] * batch.num_rows
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return predict


def language_id(docs: DataFrame) -> DataFrame:
    """docs with lang_pred and lang_score; learns from docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    prepare(spark)
    model = Model.fit(training_rows(docs))
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.trans))
    docs = docs.drop("lang_pred", "lang_score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    for f in schema:
        f.nullable = True
    return docs.mapInArrow(_predict(shared), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
