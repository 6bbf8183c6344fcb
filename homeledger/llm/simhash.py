"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, connected components.

Fingerprints are made once for each row. Only distinct ones are compared. They are dealt out by
pigeonhole keys (with the 64 bits in b blocks, two fingerprints at distance r agree on b - r blocks or
more), so no pair within the radius is lost; b follows from the number of distinct fingerprints. Inside
a key's group, rows are sorted by population count, cut into tiles, and tile pairs whose population
counts differ beyond the radius are skipped; the rest are compared by exclusive-or and bit counts. A
group above GROUP_ROWS is dealt out further, by pairs of sub-tiles. Each task unites the links as it finds
them and emits a spanning forest, never all pairs. A radius of 4 bits is a contract of op7, not a similarity: texts
that share 0.8 of their shingles differ in about 10 bits. `near_copies` is the operator for such a similarity.

near_copies links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. In any fixed order
of shingles two such sets share one among the first n - ceil(0.8 n) + 1 of each, n being the set's own size, so
fingerprints are dealt out by these shingles and none is lost; shingles that one text has alone go no further. Inside a
shingle's group tiles of fingerprints, here of 256 bits, are compared as above, at a radius of WIDE bits, and pairs of texts of
fitting sizes are candidates. They are united as they are found; of a group of texts that candidates connect, each text is
brought once to the group's task, and its pairs are verified there on their whole sets. A group of more than TILE_BYTES is
dealt out by pairs of tiles. So no pair is ever a row, and a group of near copies moves its size, not its square. At a
similarity of 0.8 a fingerprint differs in 39 to 41 bits on average, more than WIDE with a chance below 3 in 10^10; of sets under
SMALL shingles in at most 48, more than LOOSE with a chance below 10^-12. Unlike texts that share a shingle differ in 128 bits,
WIDE or fewer with a chance of 10^-9: with 64 bits it was 0.03, and such links joined ever more of the long texts to one group.

Nulls and empty texts have no words: fingerprint zero, linked like any other (near_copies: one group). Repeated rows
keep one output row each. A null doc_id gets a component of its group if the group has any id, else null. Very long
texts are hashed whole, 65,536 shingles at a time. No rows: no rows. Other columns than doc_id and text do not travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, connected_components, forest, mixed, prepare, spans_of, text_bytes, written

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Groups of one key above this many fingerprints are dealt out by pairs of sub-tiles.
GROUP_ROWS = 40_000
TILE = 512


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Majority bits of XXH64 (seed 42) over the word shingles of one lower-cased text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    hash_of, n = xxhash.xxh64_intdigest, len(words) - width + 1
    cut = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((hash_of(line[s:e], SEED) for s, e in cut), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        data, offs = text_bytes(batch.column("text"))
        data = data.tobytes()
        made = [fingerprint(data[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        fp = np.array(made, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    return docs.selectExpr("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(n: int, radius: int) -> list[int]:
    """Pigeonhole masks; more and longer keys as n grows, by estimated rows moved and pairs compared."""
    best = None
    for b in range(radius + 1, radius + 5):
        edges = [64 * i // b for i in range(b + 1)]
        parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
        keys = [sum(c) for c in combinations(parts, b - radius)]
        bits = 64 * (b - radius) // b
        cost = len(keys) * (n * 2e-6 + n * n / 2 / 2**bits * 4e-9)
        if best is None or cost < best[0]:
            best = cost, keys
    return best[1]


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label (each node's least known neighbour, by number) with the links x-y added."""
    differ = label[x] != label[y]
    if not differ.any():
        return label
    return forest(len(label), np.concatenate([np.arange(len(label)), x[differ]]), np.concatenate([label, y[differ]]))


#: Links of a group that are gathered before they are united.
HELD_PAIRS = 1 << 20


def _labels(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by (group, population count) the first row of its group that each reaches within the radius.

    Links are united as they are found: at most HELD_PAIRS of them and those of one tile pair are held.
    """
    bits = np.bitwise_count(fp).astype(np.int16)
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes, label = np.diff(new), np.arange(len(fp))
    few = np.repeat(sizes <= 48, sizes)
    for step in range(1, int(min(48, sizes.max()))):
        at = np.flatnonzero(few[:-step] & (group[step:] == group[:-step]))
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        label = _unite(label, at, at + step)
    for lo, hi in zip(new[:-1][sizes > 48], new[1:][sizes > 48], strict=True):
        own, held = np.arange(hi - lo), []

        def merge(own: np.ndarray, held: list) -> np.ndarray:
            return _unite(own, *map(np.concatenate, zip(*held, strict=True))) if held else own

        for a in range(lo, hi, TILE):
            a_end = min(a + TILE, hi)
            for b in range(a, hi, TILE):
                if bits[b] - bits[a_end - 1] > radius:
                    break
                b_end = min(b + TILE, hi)
                near = np.bitwise_count(fp[a:a_end, None] ^ fp[None, b:b_end]) <= radius
                x, y = np.nonzero(np.triu(near, 1) if a == b else near)
                x, y = x + (a - lo), y + (b - lo)
                keep = own[x] != own[y]
                held.append((x[keep], y[keep]))
                if sum(len(v) for v, _ in held) >= HELD_PAIRS:
                    own, held = merge(own, held), []
        label[lo:hi] = merge(own, held) + lo
    return label


def _linker(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, fp, rep = cols
            label = _labels(fp.view(np.uint64), key, radius)
            at = np.flatnonzero(label != np.arange(len(rep)))
            return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("grp", "fp", "rep")))
            if sum(len(x[0]) for x in held) >= 1 << 17:
                cols = tuple(map(np.concatenate, zip(*held, strict=True)))
                cut = len(cols[0]) - int(np.argmax((cols[0] != cols[0][-1])[::-1])) if cols[0][0] != cols[0][-1] else 0
                if cut:
                    yield flush(tuple(x[:cut] for x in cols))
                held = [tuple(x[cut:] for x in cols)]
        if held and sum(len(x[0]) for x in held):
            yield flush(tuple(map(np.concatenate, zip(*held, strict=True))))

    return links


def links(reps: DataFrame, n: int, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A spanning set of links (u, v) between representatives (fp, rep) within the radius."""
    key = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks(n, radius))]
    dealt = reps.select("fp", "rep", F.explode(F.array(*key)).alias("x")).select("fp", "rep", "x.t", "x.k")
    if n > group_rows:
        hot = dealt.groupBy("t", "k").count().where(F.col("count") > group_rows).selectExpr("t", "k", f"CAST(ceil(count / {group_rows / 2}) AS int) AS tiles")
        dealt = dealt.join(written(hot, "simhash-hot"), ["t", "k"], "left")
        own = F.expr("CAST(pmod(xxhash64(fp), tiles) AS int)")
        pair = F.explode(F.expr("CASE WHEN tiles IS NULL THEN array(-1) ELSE transform(sequence(0, tiles - 1), j -> least(own, j) * tiles + greatest(own, j)) END"))
        dealt = dealt.withColumn("own", own).select("fp", "rep", "t", "k", pair.alias("tile"))
    else:
        dealt = dealt.withColumn("tile", F.lit(-1))
    dealt = dealt.select(F.xxhash64("t", "k", "tile").alias("grp"), "fp", "rep").repartition("grp")
    return dealt.sortWithinPartitions("grp", F.bit_count("fp")).mapInArrow(_linker(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    made = written(fingerprints(docs), "simhash-fp")
    reps = written(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    joined = connected_components(links(reps, reps.count(), radius), "simhash-links")
    named = reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(named, "fp", "left").select("doc_id", "fp", "component_id")


#: Of near_copies: words of a shingle; least similarity as a fraction of whole numbers, so that comparisons are exact.
COPY_WORDS, OVER, UNDER = 5, 4, 5
#: Radius for candidates, of 64 * LANES bits; LOOSE is that of sets of fewer shingles than SMALL.
LANES, WIDE, LOOSE, SMALL = 4, 80, 96, 16
FP = [f"f{i}" for i in range(LANES)]
#: About so many texts are looked through for repeated shingles; SEEN of them make a shingle frequent, MOST are listed.
#: Frequent shingles come last in the order: this saves work and changes no result.
SAMPLE, SEEN, MOST = 8_000, 3, 100_000
#: Texts that meet in a task, and nodes that are broadcast, at most.
TILE_BYTES, FEW_NODES = 4 << 20, 500_000


def shingles(text: bytes, width: int = COPY_WORDS) -> np.ndarray:
    """Distinct XXH64 values of the word shingles of one lower-cased text, sorted, as signed longs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    hash_of, n = xxhash.xxh64_intdigest, len(words) - width + 1
    cut = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((hash_of(line[s:e], SEED) for s, e in cut), np.uint64, n).view(np.int64))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes: LANES numbers, each from the hashes mixed in a way of its own; zeros for none."""
    ones, hashes = np.zeros(64 * LANES, np.int64), hashes.view(np.uint64)
    for lo in range(0, len(hashes), 1 << 12):
        part = hashes[lo : lo + (1 << 12)]
        lanes = np.stack([part, *(mixed(part ^ np.uint64(i)) for i in range(1, LANES))], axis=1).astype("<u8").view(np.uint8)
        ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def _lists(found: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def _made(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offs = text_bytes(batch.column("text"))
    data = data.tobytes()
    return [shingles(data[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(_made(batch))], ["node", "xs"])


def _prefixes(frequent: np.ndarray):
    """frequent: listed shingles, the rarest first."""
    at = np.argsort(frequent)
    values = frequent[at]

    def first(xs: np.ndarray) -> np.ndarray:
        n = len(xs)
        if not n:
            return xs
        rank = np.zeros(n, np.int64)
        if len(values):
            i = np.minimum(np.searchsorted(values, xs), len(values) - 1)
            rank = np.where(values[i] == xs, at[i] + 1, 0)
        return xs[np.lexsort((xs, rank))[: n - -(-OVER * n // UNDER) + 1]]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            made = _made(batch)
            n = np.array([len(x) for x in made], np.int32)
            node = np.where(n > 0, batch.column("node").to_numpy(zero_copy_only=False), 0)
            fp = np.array([_majority(x) for x in made], np.uint64).view(np.int64)
            cols = [batch.column("doc_id").cast(pa.int64()), batch.column("node"), pa.array(node), pa.array(n), *map(pa.array, fp.T.copy()), _lists([first(x) for x in made])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "node", "n", *FP, "xs"])

    return prefixes


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by names[0], in pieces that hold whole groups of it."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy() for c in names))
        if sum(len(c[0]) for c in held) >= at_once:
            cols = tuple(map(np.concatenate, zip(*held, strict=True)))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in cols)
            held = [tuple(c[cut:] for c in cols)]
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (x, node) sorted by x those whose x another row has too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, node = (batch.column(c).to_numpy() for c in ("x", "node"))
        again = False
        if held is not None:
            again = bool(held[0] == x[0])
            if held[2] or again:
                yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["x", "node"])
        same = np.concatenate(([again], x[1:] == x[:-1], [False]))
        keep = (same[:-1] | same[1:])[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]), pa.array(node[:-1][keep])], ["x", "node"])
        held = x[-1], node[-1], bool(same[-2])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["x", "node"])


def _candidates(fp_a, n_a, fp_b, n_b, radius: int, small: int) -> np.ndarray:
    """Whether pairs are near enough and of sizes that allow the similarity; lanes of fingerprints are the last axis."""
    differ = np.bitwise_count(fp_a ^ fp_b).sum(axis=-1, dtype=np.int16)
    near = differ <= np.where((n_a < small) | (n_b < small), max(LOOSE, radius), radius)
    return near & (n_a * UNDER >= n_b * OVER) & (n_b * UNDER >= n_a * OVER)


def _connected(radius: int, small: int):
    """A spanning forest (u, v) of the candidate pairs of each group, of rows (grp, *FP, n, node) sorted by grp."""

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, n, node, *fp in _whole_groups(batches, ("grp", "n", "node", *FP)):
            bits, n, label = np.stack(fp, axis=1).view(np.uint64), n.astype(np.int64), np.arange(len(grp))
            new = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
            sizes = np.diff(new)
            many, links = np.repeat(sizes, sizes), []
            for step in range(1, min(48, int(sizes.max()))):  # small groups, all at once
                at = np.flatnonzero((many[:-step] <= 48) & (grp[step:] == grp[:-step]))
                at = at[_candidates(bits[at], n[at], bits[at + step], n[at + step], radius, small)]
                links.append((at, at + step))
            if links:
                label = _unite(label, *map(np.concatenate, zip(*links, strict=True)))
            for lo, hi in zip(new[:-1][sizes > 48].tolist(), new[1:][sizes > 48].tolist(), strict=True):
                own = np.arange(hi - lo)
                for a in range(lo, hi, TILE):
                    a_end = min(a + TILE, hi)
                    for b in range(a, hi, TILE):
                        b_end = min(b + TILE, hi)
                        ok = _candidates(bits[a:a_end, None], n[a:a_end, None], bits[None, b:b_end], n[None, b:b_end], radius, small)
                        ok &= own[a - lo : a_end - lo, None] != own[None, b - lo : b_end - lo]
                        x, y = np.nonzero(ok)
                        own = _unite(own, x + (a - lo), y + (b - lo)) if len(x) else own
                label[lo:hi] = own + lo
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["u", "v"])

    return connected


def similar(sets: list[np.ndarray], radius: int, small: int) -> np.ndarray:
    """For each set the first one that it reaches over pairs of the similarity; only pairs not yet united are counted out."""
    size = np.array([len(x) for x in sets], np.int64)
    bits = np.array([_majority(x) for x in sets], np.uint64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends, label = np.cumsum(size), np.arange(len(sets))
    held = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    for i in range(len(sets) - 1):
        js = i + 1 + np.flatnonzero(_candidates(bits[i], size[i], bits[i + 1 :], size[i + 1 :], radius, small) & (label[i + 1 :] != label[i]))
        if not len(js):
            continue
        own = ids[ends[i] - size[i] : ends[i]]
        held[own] = True
        common = np.add.reduceat(held[ids[spans_of(size[js], ends[js] - size[js])]], np.cumsum(size[js]) - size[js], dtype=np.int64)
        held[own] = False
        js = js[common * (OVER + UNDER) >= (size[i] + size[js]) * OVER]
        if len(js):
            old = np.unique(label[np.append(js, i)])
            label[np.isin(label, old)] = old[0]
    return label


def _alike(radius: int, small: int):
    """A spanning forest (u, v) of the similar pairs of each group, of rows (grp, node, text) sorted by grp."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            label, node = similar(sets, radius, small), np.array(nodes, np.int64)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["u", "v"])

        for batch in batches:
            for block in blocks([batch], "text"):
                for g, node, xs in zip(block.column("grp").to_pylist(), block.column("node").to_pylist(), _made(block), strict=True):
                    if g != grp:
                        if len(nodes) > 1:
                            yield flush()
                        grp, nodes, sets = g, [], []
                    nodes.append(node)
                    sets.append(xs)
        if len(nodes) > 1:
            yield flush()

    return alike


def _frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles that several texts of a sample have, the rarest first."""
    every = max(1, rows // SAMPLE)
    part = docs.select("text", F.xxhash64("text").alias("node")).where(f"pmod(node, {every}) = 0").mapInArrow(_sets, "node long, xs array<long>")
    seen = part.dropDuplicates(["node"]).select(F.explode("xs").alias("x")).groupBy("x").count().where(F.col("count") >= SEEN)
    got = seen.orderBy(F.desc("count"), "x").limit(MOST).select("x").toArrow().column("x").to_numpy()
    return got[::-1].copy()


def _dealt(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows (with key, node) dealt out and sorted by grp: the key, or, where it is in hot (key, tiles), the key and a pair of sub-tiles."""
    if hot is not None:
        own = F.expr("CAST(pmod(xxhash64(node), tiles) AS int)")
        pair = F.explode(F.expr("CASE WHEN tiles IS NULL THEN array(-1) ELSE transform(sequence(0, tiles - 1), j -> least(own, j) * tiles + greatest(own, j)) END"))
        rows = rows.join(hot, key, "left").withColumn("own", own).withColumn("tile", pair).withColumn("grp", F.xxhash64(key, "tile")).drop("own", "tile", "tiles", key)
    else:
        rows = rows.withColumnRenamed(key, "grp")
    return rows.repartition("grp").sortWithinPartitions("grp", "node")


def _crowded(rows: DataFrame, key: str, size: str, most: int, name: str) -> DataFrame | None:
    """(key, tiles) of the keys whose rows are more than most in all, tiles of half as much; None if there are none."""
    many = rows.groupBy(key).agg(F.expr(size).alias("_n")).where(F.col("_n") > most).selectExpr(key, f"CAST(ceil(_n / {most / 2}) AS int) AS tiles")
    many = written(many, name)
    return None if many.isEmpty() else many


def near_copies(docs: DataFrame, radius: int = WIDE, small: int = SMALL, group_rows: int = GROUP_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, h, component_id, first) for each row of docs (doc_id, text).

    component_id is the least doc_id of its near copies, h the text's hash; first: the row is the one of its
    group that stays, or equal to it in doc_id and text (of several texts of the least doc_id that of the least hash).
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = docs.count()
    kinds = ", ".join(f"{c} long" for c in FP)
    made = docs.withColumn("node", F.xxhash64("text")).mapInArrow(_prefixes(_frequent(docs, n)), f"doc_id long, h long, node long, n int, {kinds}, xs array<long>")
    made = written(made, "copies-prefixes")
    known = made.where("n > 0").dropDuplicates(["node"])
    rows = known.select(F.explode("xs").alias("x"), "node").repartition("x").sortWithinPartitions("x").mapInArrow(_shared, "x long, node long")
    rows = written(rows, "copies-shared")
    hot = _crowded(rows, "x", "count(*)", group_rows, "copies-hot") if n > group_rows else None
    rows = rows.join(known.select("node", "n", *FP), "node")
    links = _dealt(rows, "x", hot).select("grp", "n", "node", *FP).mapInArrow(_connected(radius, small), "u long, v long")
    groups = written(connected_components(links, "copies-candidates").selectExpr("node", "component AS c"), "copies-groups")
    few = F.broadcast(groups) if groups.count() <= FEW_NODES else groups  # 16 bytes a node
    texts = docs.select(F.xxhash64("text").alias("node"), "text").join(few, "node").dropDuplicates(["node"])
    texts = written(texts, "copies-texts")
    hot = _crowded(texts, "c", "sum(octet_length(text))", tile_bytes, "copies-crowded")
    links = _dealt(texts, "c", hot).select("grp", "node", "text").mapInArrow(_alike(radius, small), "u long, v long")
    joined = connected_components(links, "copies-components")
    named = made.select("doc_id", "h", "node").join(joined, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("c"))
    named = written(named, "copies-rows")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"))
    found = named.join(least, "c")
    return found.select("doc_id", "h", "component_id", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))).alias("first"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
