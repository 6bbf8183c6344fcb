"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from homeledger.llm import simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Least index of each text's component over all pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def corpus():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    common, texts = words(12), [None, "", "  \n", "One two", "one  two", "one two three"]
    for n in (4, 5, 6, 40, 90, 300):
        base = words(n)
        texts += [base, base.upper() + " "]
        for edits in (1, 2, 3, 5, 8):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(n)] = "changed"
            texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w, *words(edits * n // 60).split()])]
    return texts + [words(rng.randrange(20, 60)) + " " + common for _ in range(60)]


@pytest.mark.parametrize(("seen", "rows"), [(3, 40_000), (10**9, 40_000), (3, 6)])
def test_near_copies(spark, monkeypatch, seen, rows):
    monkeypatch.setattr(simhash, "SEEN", seen)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, group_rows=rows, tile_bytes=rows * 100).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len({t for t in texts if t})


def test_star_of_copies_that_are_not_alike(spark):
    """Copies of one text with edits of their own: linked through the text or through each other, never dropped for their number."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            w[rng.randrange(120)] = f"e{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_unite_in_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    fp = np.sort(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1
    want = simhash.forest(len(fp), *np.nonzero(near))
    for tile, held in ((512, 1 << 20), (16, 1), (7, 50)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "HELD_PAIRS", held)
        assert np.array_equal(simhash._labels(fp, np.zeros(len(fp), np.int64), 1), want)


def test_stage_drops_near_copies(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame(rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    root = brute([r.text for r in rows])
    assert kept == [r.doc_id for i, r in enumerate(rows) if root[i] == i]


def test_stage_drops_repeated_rows(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a  b c d e f", "y"), (1, "other words here", "z"), (None, "no id", "n"), (None, None, "n")], "doc_id long, text string, fp string")
    kept = sorted(((r.doc_id, r.text, r.fp) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f", "x"), (1, "other words here", "z"), (None, "no id", "n"), (None, None, "n")], key=repr)


def test_unlike_texts_do_not_meet(spark, monkeypatch):
    """Texts that share a passage and little else are not brought together: with chance links the group would be as large as the corpus."""
    monkeypatch.setattr(simhash, "SEEN", 10**9)  # so the passage is not put last
    rng, brought, write = random.Random(5), {}, simhash.written
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common = words(12)
    docs = spark.createDataFrame([(i, f"{words(80)} {common}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "written", lambda df, name, *rest: brought.setdefault(name, write(df, name, *rest)))
    assert simhash.near_copies(docs).where("doc_id = component_id").count() == 400
    assert brought["copies-texts"].count() == 0


def test_shared_keys_in_any_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.sort(rng.integers(0, 12, rng.integers(0, 25)))
        cut = sorted(rng.integers(0, len(x) + 1, 3))
        parts = [pa.RecordBatch.from_arrays([pa.array(x[a:b]), pa.array(np.arange(a, b))], ["x", "node"]) for a, b in zip([0, *cut], [*cut, len(x)], strict=True)]
        got = [v for part in simhash._shared(iter(parts)) for v in part.column("node").to_pylist()]
        assert got == [i for i, v in enumerate(x) if (x == v).sum() > 1]
