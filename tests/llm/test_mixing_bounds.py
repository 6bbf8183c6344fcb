"""Mixing: tokens of the calibrated probabilities, not only of the weights, meet the targets."""

import numpy as np

from homeledger.llm import mixing

CELLS = [("a", "x", "0", 400), ("a", "y", "0", 100), ("a", "x", "1", 300), ("b", "y", "1", 50), ("b", "x", "0", 90), ("b", "y", "0", 60)]
EVEN = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.7, "y": 0.3}, "topic": 1.0}


def made(spark, targets, fraction, **more):
    rows = spark.createDataFrame(CELLS, "source string, lang string, topic string, mix_tokens long")
    return mixing.probabilities(rows, targets, fraction, steps=more.pop("steps", 300), **more)[0].toPandas()


def marginal(cells, d):
    kept = cells.probability * cells.tokens
    return (kept.groupby(cells[d]).sum() / kept.sum()).to_dict()


def test_probabilities_meet_targets(spark):
    cells = made(spark, EVEN, 0.65)
    assert (cells.probability >= 1 - 1e-9).any() and cells.probability.max() <= 1
    for d in ("source", "lang"):
        assert all(abs(marginal(cells, d)[k] - v) < 1e-4 for k, v in EVEN[d].items()), d
    assert abs((cells.probability * cells.tokens).sum() / cells.tokens.sum() - 0.65) < 1e-6


def test_shortage_is_spread(spark):
    targets = {"source": 1.0, "lang": {"x": 0.4, "y": 0.6}, "topic": 1.0}
    cells = made(spark, targets, 0.7)
    assert (cells.probability[cells.lang == "y"] > 0.999).all()
    assert abs(marginal(cells, "lang")["y"] - 210 / 700) < 1e-3
    assert np.allclose(mixing.reachable(np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.4, 0.9])), [0.2, 0.4, 0.4])


def test_table_calibrates_alike(spark):
    for targets, fraction in ((EVEN, 0.65), ({"source": 1.0, "lang": {"x": 0.4, "y": 0.6}, "topic": 1.0}, 0.7)):
        few, many = (made(spark, targets, fraction, steps=3, max_cells=m).sort_values(list(mixing.DIMENSIONS)) for m in (100, 0))
        assert np.allclose(few.probability, many.probability)


def plain_fit(cells, wanted, turns):
    """Iterative proportional fitting over a dict of cells, without numpy."""
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(turns):
        for d, shares in enumerate(wanted):
            got = dict.fromkeys(shares, 0.0)
            for cell, tokens in cells.items():
                got[cell[d]] += weight[cell] * tokens
            for cell in cells:
                weight[cell] *= shares[cell[d]] * total / got[cell[d]] if got[cell[d]] else 0.0
    return weight


def test_weights_against_a_plain_fit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.annotated(docs.select("doc_id", "text", "source", "lang"))
    found = mixing.probabilities(rows, steps=12, tolerance=0.0)[0].toPandas()
    keys = [tuple(r) for r in found[list(mixing.DIMENSIONS)].itertuples(index=False)]
    cells = dict(zip(keys, found.tokens.tolist(), strict=True))
    wanted = []
    for d in range(3):
        sums: dict = {}
        for cell, tokens in cells.items():
            sums[cell[d]] = sums.get(cell[d], 0) + tokens
        root = {k: v**0.5 for k, v in sums.items()}  # the default targets temper shares by 0.5
        wanted.append({k: v / sum(root.values()) for k, v in root.items()})
    plain = plain_fit(cells, wanted, 12)
    assert np.allclose([plain[k] for k in keys], found.weight, rtol=1e-9)


def test_every_margin_that_can_be_met_is(spark):
    for d in mixing.DIMENSIONS:
        cells = made(spark, EVEN, 0.65)
        want = EVEN[d] if isinstance(EVEN[d], dict) else {k: v / 1000 for k, v in (("0", 650), ("1", 350))}
        assert all(abs(marginal(cells, d)[k] - v) < 1e-3 for k, v in want.items()), d
