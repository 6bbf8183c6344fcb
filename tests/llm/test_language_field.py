"""The field's predictions against a plain decoder, many labels, and code-switched text."""

import math
import random
import zlib

import pyarrow as pa

from homeledger.llm import language_id
from homeledger.llm.common import _BYTES, _P

M = (1 << 64) - 1


def finaliser(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def slice_hash(raw):
    """By its definition: a polynomial of the mixed bytes, then the length, then the finaliser."""
    total, power = 0, 1
    for b in raw:
        total, power = (total + int(_BYTES[b]) * power) & M, power * _P & M
    return finaliser((total + len(raw) * 0xD6E8FEB86659FD93) & M)


def word_features(word, bits):
    upper, raw = 65 <= word[0] <= 90, bytes(c + 32 if 65 <= c <= 90 else c for c in word)
    slot = lambda part, kind: (slice_hash(part) ^ (kind * 0x9E3779B97F4A7C15 & M)) & ((1 << bits) - 1)
    out = [slot(raw, 1), int(upper)]
    for n in range(1, language_id.AFFIX + 1):
        out += [slot(raw[:n], 10 + n), slot(raw[max(0, len(raw) - n) :], 20 + n)]
    return out + [slot(raw[i : i + n], 30 + n) for n in (2, 3) for i in range(len(raw) - n + 1)]


def decoded(model, text):
    """Label and score of a text, word by word and with logarithms, without numpy."""
    raw, words, at = (text or "").encode(), [], None
    for i, c in enumerate([*raw, 0]):
        letter = c >= 128 or 65 <= c <= 90 or 97 <= c <= 122
        if letter and at is None:
            at = i
        if not letter and at is not None:
            words, at = [*words, raw[at:i]], None
    if not text or not any(map(str.isalpha, text)) or not words:
        return "und", 0.0
    labels = range(len(model.labels))
    cache, plus = {}, lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    for w in set(words):
        ids = word_features(w, model.bits)
        cache[w] = [sum(float(model.weights[i, k]) for i in ids) for k in labels]
    e, t = [cache[w] for w in words], model.trans.tolist()
    front = [e[0]]
    for x in e[1:]:
        front.append([plus([front[-1][j] + t[j][k] for j in labels]) + x[k] for k in labels])
    back = [[0.0] * len(labels)]
    for x in reversed(e[1:]):
        back.append([plus([t[j][k] + x[k] + back[-1][k] for k in labels]) for j in labels])
    back.reverse()
    sums, z = [0.0] * len(labels), plus(front[-1])
    for w, f, b in zip(words, front, back, strict=True):
        for k in labels:
            sums[k] += len(w) * math.exp(f[k] + b[k] - z)
    best = max(labels, key=lambda k: sums[k])
    return model.labels[best], sums[best] / sum(map(len, words))


def test_every_text_against_a_plain_decoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.Model.fit(language_id.training_rows(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op3_language_id(spark, sf).collect()}
    checked = 0
    for r in docs.collect():
        if len(r.text or "") > 12_000:  # the plain form takes minutes for these
            continue
        label, score = decoded(model, r.text)
        assert got[r.doc_id][0] == label and abs(got[r.doc_id][1] - score) < 1e-4, r.doc_id
        checked += 1
    assert checked > 150


def corpus(labels, per=3, long=0):
    rng, rows = random.Random(1), []
    for k in range(labels):
        stem = [chr(97 + (k * 7 + i * 3) % 26) + chr(97 + (k + i) % 26) + chr(97 + (k // 26 + i) % 26) for i in range(4)]
        for _ in range(per):
            rows.append((len(rows), " ".join("".join(rng.choice(stem) for _ in range(2)) for _ in range(30 + long)), f"l{k:03d}"))
    return rows


def test_no_label_is_lost(spark):
    docs = spark.createDataFrame(corpus(450), "doc_id long, text string, lang string")
    rows = language_id.training_rows(docs, sample_bytes=20_000)  # 44 bytes a label: no text fits whole
    free = {f"l{i // 3:03d}" for i in range(1350) if zlib.crc32(str(i).encode()) % 5}
    assert {y for _, y in rows} == free
    whole = {w for _, x, _ in corpus(450) for w in x.split()}
    assert all(set(x.split()) <= whole and len(x.encode()) <= 44 for x, _ in rows)
    assert language_id.bits_for(450) < language_id.BITS and 450 << language_id.bits_for(450) <= language_id.WEIGHTS
    model = language_id.Model.fit(rows[:60], epochs=1)
    assert model.bits == language_id.bits_for(len(model.labels))


def test_code_switched_text():
    rng = random.Random(2)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    a, b = ("the", "house", "with", "water", "thing"), ("der", "haus", "mit", "wasser", "ding")
    model = language_id.Model.fit([(say(a, 60), "en") for _ in range(20)] + [(say(b, 60), "de") for _ in range(20)])
    text = say(a, 12) + ". " + say(b, 12) + ", " + say(a, 12)
    spans = language_id.word_spans(model, text)
    assert [x for *_, x in spans] == ["en", "de", "en"]
    assert all(set(text.encode()[s:e].decode().replace(".", "").replace(",", "").split()) <= set(a if x == "en" else b) for s, e, x in spans)
    got, scores = language_id.document_scores(model, pa.array([text, say(b, 9), "12", None]))
    assert got == ["en", "de", "und", "und"] and scores[0] < scores[1]
