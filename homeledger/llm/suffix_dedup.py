"""Removal of repeated byte strings by suffix arrays of linear grouping construction.

A byte of a text goes if it lies in a string of LENGTH bytes that also starts earlier in the corpus (smaller
doc_id, or the same document and an earlier start). Every string of LENGTH bytes is found through its anchor,
the least hash of its GRAM-byte substrings; a run of neighbouring strings with one anchor, with the bytes
that it covers, is a context.

1. Hashes of anchors are counted (partial sums, 8 bytes a row). Those that occur once are done with.
2. Contexts of the others are written, found through a bitmap of fixed size. Of equal contexts all but the
   earliest repeat wholly: partial minima and a join, without a task for a hot passage.
3. Different contexts with the same anchor repeat in part. Those of the anchors' first contexts that share
   more than the anchor, the anchor as one symbol, are concatenated in blocks; a suffix array gives the order of their strings, equal ones
   adjacent, and all but the earliest of these repeat. Contexts of an anchor with more than GROUP of them are dealt
   out over several blocks; the earliest of each block's equal strings are merged by their bytes.

The suffix array is built in two linear phases. First, groups of suffixes that share a Lyndon prefix, from
groups of one first symbol on, are visited in descending order; pointers to previous smaller suffixes say
which lower suffixes the group's prefix extends, and how often; these move to new groups just after their
old ones. Then suffixes are emitted in ascending order: each placed suffix places, along the pointers, those
that end where it starts, each at the next place of its group. Nothing is renamed or solved recursively.

Null text is empty. Texts under LENGTH bytes stay. Rows of one doc_id are ordered by their text's hash, whole
repeated rows are one document, null doc_ids come last. Every input row keeps one output row; an empty table gives
none. Very long texts are cut into contexts like any others. Only doc_id and text are read; other columns do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _powers, bitmap, blocks, prepare, spans_of, table, text_bytes, with_bit, written

LENGTH, GRAM = 100, 56
#: Bits of the bitmap of anchors that occur more than once (16 MB).
BITS = 27
#: Bits of the bitmaps of contexts that go on (4 MB); ranges of starts whose shared bytes are compared.
MARK_BITS, SEGMENTS = 25, 4
#: Contexts of an anchor that one task sorts; symbols of a block.
GROUP, BLOCK = 1000, 200_000
#: Texts with the most copies, told apart before all else: a fixed bound.
COPIES = 4096
_LAST = (1 << 63) - 1
_TEXT_BLOCK = 2 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of symbols; the last one must be less than all others."""
    n = len(text)
    first = sorted(set(text))
    number = {c: i for i, c in enumerate(first)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in first]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(first) - 1)), [*range(1, len(first)), -1]
    done, prev = bytearray(n), [-1] * n
    g = len(first) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        if len(own) > 1:
            own.sort()
        hits: dict[int, int] = {}
        for s in own:  # the nearest suffix on the left in a lower group
            p = s - 1
            while p >= 0 and (done[p] or group[p] == g):
                p = prev[p]
            prev[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        for s in own:
            done[s] = 1
        if hits:
            split: dict[tuple[int, int], list[int]] = {}
            for p, times in hits.items():
                split.setdefault((-times, group[p]), []).append(p)
            for key in sorted(split) if len(split) > 1 else split:
                old, new, up = key[1], len(members), above[key[1]]
                members.append(split[key])  # just after its old group; more repetitions of the prefix came first
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for p in split[key]:
                    group[p] = new
        g = below[g]
    size = [0] * len(members)
    for g in group:
        size[g] += 1
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = above[g]
    out, placed = [n - 1] * n, bytearray(n)
    placed[n - 1] = 1
    place[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, last start and the anchor's hash.

    Rows of data are given by offsets; no string crosses a row.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data) - length + 1
    if n <= 0:
        return none
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    raw = sums[gram:] - sums[:-gram]
    raw *= down[: len(raw)]
    del sums
    raw ^= raw >> np.uint64(32)
    width, least, span = length - gram + 1, raw, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    valid = np.zeros(n + 1, np.int8)  # strings that lie in one row
    ok = np.flatnonzero(np.diff(offs) >= length)
    if not len(ok):
        return none
    np.add.at(valid, offs[ok], 1)
    np.add.at(valid, offs[ok + 1] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (raw[: n - 1] == least[:-1]) | ~valid[:-1]
    new &= valid
    lo = np.flatnonzero(new)
    ends = np.zeros(n, bool)
    ends[:-1] = new[1:] | ~valid[1:]
    ends[-1] = True
    return lo, np.flatnonzero(ends & valid), least[lo]


def _located(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Start of the anchor in each run: its least substring's first place, by the same hash."""
    up, down = _powers(length + 1)
    at = np.empty(len(lo), np.int64)
    width = length - gram + 1
    for a in range(0, len(lo), 20_000):
        own = _BYTES[data[hi[a : a + 20_000, None] + np.arange(length)]] * up[:length]
        sums = np.zeros((len(own), length + 1), np.uint64)
        np.cumsum(own, axis=1, out=sums[:, 1:])
        raw = (sums[:, gram:] - sums[:, :-gram]) * down[:width]
        raw ^= raw >> np.uint64(32)
        at[a : a + 20_000] = hi[a : a + 20_000] + raw.argmin(axis=1)
    return at


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text", _TEXT_BLOCK):
        h = anchors(*text_bytes(batch.column("text")))[2]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


CONTEXT = "d long, t long, lo int, hi int, a int, h long, ctx binary"


def _contexts(bits):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in blocks(batches, "text", _TEXT_BLOCK):
            data, offs = text_bytes(batch.column("text"))
            lo, hi, h = anchors(data, offs)
            place = h % np.uint64(1 << BITS)
            keep = np.flatnonzero(held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            lo, hi, h = lo[keep], hi[keep], h[keep]
            a = _located(data, lo, hi, LENGTH, GRAM)
            row = np.searchsorted(offs, lo, "right") - 1
            size = hi - lo + LENGTH
            for s in range(0, len(lo), 20_000):
                x = slice(s, s + 20_000)
                taken = data[spans_of(size[x], lo[x])]
                ends = np.concatenate(([0], np.cumsum(size[x]))).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(taken))])
                d, t = (batch.column(c).take(pa.array(row[x])) for c in ("d", "t"))
                base = offs[row[x]]
                small = [pa.array((v[x] - base).astype(np.int32)) for v in (lo, hi, a)]
                yield pa.RecordBatch.from_arrays([d, t, *small, pa.array(h[x].view(np.int64)), ctx], ["d", "t", "lo", "hi", "a", "h", "ctx"])

    return contexts


def _sorted_block(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of a block of contexts (h, d, t, lo, hi, a, ctx) in their order: d, t, start, context, and whether an equal one comes before."""
    symbols, valid, owner, start = [], [], [], []
    name: dict[int, int] = {}
    for k, (h, _, _, lo, hi, a, ctx) in enumerate(rows):
        at = len(symbols)
        symbols += [x + 2 for x in ctx[: a - lo]]
        symbols.append(300 + name.setdefault(h, len(name)))
        symbols += [x + 2 for x in ctx[a - lo + GRAM :]]
        symbols.append(1)
        many = hi - lo + 1
        valid += range(at, at + many)
        owner += [k] * many
        start += range(lo, hi + 1)
    symbols.append(0)
    text, width = np.array(symbols), LENGTH - GRAM + 1
    number = np.full(len(symbols), -1, np.int64)
    number[valid] = np.arange(len(valid))
    order = number[np.array(suffix_array(symbols), np.int64)]
    order = order[order >= 0]  # strings of LENGTH bytes in lexicographic order
    strings = text[np.array(valid)[order][:, None] + np.arange(width)]
    same = np.concatenate(([False], (strings[1:] == strings[:-1]).all(axis=1)))
    cls = np.cumsum(~same)
    own = np.array(owner)[order]
    d, t = (np.array([r[i] for r in rows], np.int64)[own] for i in (1, 2))
    s = np.array(start, np.int64)[order]
    rank = np.lexsort((s, t, d, cls))
    later = np.concatenate(([False], cls[rank][1:] == cls[rank][:-1]))
    return d[rank], t[rank], s[rank], own[rank], later


def _groups(merge: bool):
    """Blocks of contexts of whole groups (rows sorted by h, part), each by a suffix array; merge: also the earliest of equal strings, with its bytes."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            d, t, s, own, later = _sorted_block([r[1:] for r in held])
            out: list[list] = []
            for row in sorted(zip(d[later].tolist(), t[later].tolist(), s[later].tolist(), strict=True)):  # neighbouring strings become one span
                if out and out[-1][:2] == [*row[:2]] and row[2] <= out[-1][3]:
                    out[-1][3] = row[2] + LENGTH
                else:
                    out.append([*row, row[2] + LENGTH, None, None])
            if merge:
                first = ~later
                for x, y, z, k in zip(d[first].tolist(), t[first].tolist(), s[first].tolist(), own[first].tolist(), strict=True):
                    h, lo, ctx = held[k][1], held[k][4], held[k][7]
                    out.append([x, y, z, z + LENGTH, h, ctx[z - lo : z - lo + LENGTH]])
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["d", "t", "s", "e", "h", "w"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "h", "d", "t", "lo", "hi", "a", "ctx")]
            for row in zip(*cols, strict=True):
                if size >= BLOCK and row[:2] != held[-1][:2]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[7]) - GRAM + 2
        if held:
            yield flush()

    return groups


SPANS = "d long, t long, s int, e int, h long, w binary"


def _promising(part: DataFrame) -> DataFrame:
    """Contexts that may share a string with another one of their anchor.

    Strings that start d bytes before the anchor, d in one of SEGMENTS ranges, share the bytes that all strings
    of that range hold; a context without a shared one has nothing to offer. Hashes of these are counted.
    """
    edge = [(LENGTH - GRAM + 1) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    keys = []
    for i, (d0, d1) in enumerate(zip(edge, (e - 1 for e in edge[1:]), strict=False)):
        held = F.expr(f"substring(ctx, a - lo - {d0} + 1, {LENGTH - d1 + d0})")
        keys.append(F.when(F.expr(f"a - lo >= {d0} AND a - hi <= {d1}"), F.xxhash64("h", F.lit(i), held)))
    part = part.withColumn("keys", F.array(*keys))
    shared = part.select(F.explode(F.array_compact("keys")).alias("k")).groupBy("k").count().where("count > 1").select("k")
    shared = written(shared, "contexts-shared")
    if shared.count() > (1 << MARK_BITS) // 4:
        return part.drop("keys")
    maps, hits = bitmap(shared, "k", MARK_BITS), F.lit(False)
    for i in range(SEGMENTS):
        part = with_bit(part, F.coalesce(F.col("keys")[i], F.lit(0)), maps, MARK_BITS, f"hit{i}")
        hits = hits | (F.col(f"hit{i}") & F.col("keys")[i].isNotNull())
    return part.where(hits).drop("keys", *(f"hit{i}" for i in range(SEGMENTS)))


def repeats(texts: DataFrame) -> DataFrame:
    """Spans (d, t, s, e), overlapping, of bytes covered by strings that start earlier; texts: (d, t, text)."""
    spark = texts.sparkSession
    prepare(spark)
    texts = texts.select("d", "t", "text").where(f"octet_length(text) >= {LENGTH}")
    often = texts.select("text").mapInArrow(_hashes, "h long").groupBy("h").count().where("count > 1")
    place = often.select(F.expr(f"h & {(1 << BITS) - 1}").alias("x"))
    maps = place.select(F.expr("shiftright(x, 15)").cast("int").alias("part"), F.expr("x & 32767").alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    bits = bytearray(1 << (BITS - 3))
    for r in maps.collect():  # at most 2**BITS bits
        bits[r.part * 4096 : r.part * 4096 + 4096] = r["map"]
    seen = texts.mapInArrow(_contexts(spark.sparkContext.broadcast(bytes(bits))), CONTEXT)
    seen = written(seen.withColumn("c", F.xxhash64("ctx")), "contexts")

    first = seen.groupBy("h", "c").agg(F.min(F.struct("d", "t", "lo")).alias("f"), F.count("*").alias("n"))
    first = written(first, "contexts-first")
    again = seen.select("d", "t", "lo", "hi", "h", "c").join(first.where("n > 1").select("h", "c", "f"), ["h", "c"])
    whole = again.where("struct(d, t, lo) <> f").selectExpr("d", "t", "lo AS s", f"hi + {LENGTH} AS e")

    split = first.groupBy("h").agg(F.count("*").alias("many")).where("many > 1").select("h")
    part = written(first.join(split, "h").select("h", F.col("f.d").alias("d"), F.col("f.t").alias("t"), F.col("f.lo").alias("lo")), "contexts-part")
    own = seen.drop("c")
    if part.count() <= (1 << MARK_BITS) // 4:  # few: a bitmap keeps the others' bytes from being moved
        key = F.xxhash64("h", "d", "t", "lo")
        own = with_bit(own, key, bitmap(part.select(key.alias("k")), "k", MARK_BITS), MARK_BITS, "may").where("may").drop("may")
    part = written(own.join(part, ["h", "d", "t", "lo"]).dropDuplicates(["h", "d", "t", "lo"]), "contexts-split")  # repeated rows
    part = written(_promising(part), "contexts-promising")
    often = written(part.groupBy("h").agg(F.count("*").alias("many")).where(f"many > {GROUP}"), "anchors-hot")
    crowded = often.count() > 0
    few = part.join(often.select("h"), "h", "left_anti") if crowded else part
    context = ("h", "d", "t", "lo", "hi", "a", "ctx")
    tasks = max(1, -(-part.count() // 4000))  # given outright: sorting costs more than its bytes say
    few = few.select(F.lit(0).alias("part"), *context).repartition(tasks, "h").sortWithinPartitions("h")
    few = few.mapInArrow(_groups(merge=False), SPANS).select("d", "t", "s", "e")
    if not crowded:
        return whole.unionByName(few)

    # anchors of many contexts: blocks of about GROUP contexts, the earliest strings of all blocks merged
    hot = part.join(often, "h").withColumn("part", F.expr(f"CAST(pmod(xxhash64(ctx), ceil(many / {GROUP})) AS int)")).select("part", *context)
    hot = written(hot.repartition(tasks, "h", "part").sortWithinPartitions("h", "part").mapInArrow(_groups(merge=True), SPANS), "contexts-hot")
    led = hot.where("w IS NOT NULL").select("h", "w", F.struct("d", "t", "s").alias("p"))
    earliest = led.groupBy("h", "w").agg(F.min("p").alias("f"), F.count("*").alias("n")).where("n > 1").select("h", "w", "f")
    led = led.join(earliest, ["h", "w"]).where("p <> f").selectExpr("p.d", "p.t", "p.s", f"p.s + {LENGTH} AS e")
    return whole.unionByName(few).unionByName(hot.where("w IS NULL").select("d", "t", "s", "e")).unionByName(led)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, whole, spans in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            merged: list[list[int]] = [[0, len(raw)]] if whole else []
            for x in sorted((x["s"], x["e"]) for x in spans or ()) if not whole else ():
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            at, rest = 0, []
            for s, e in merged:
                rest.append(raw[at:s])
                at = e
            kept = b"".join([*rest, raw[at:]])
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[c].append(v)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], t) for c, t in kinds.items())], ["doc_id", *kinds])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept: the remaining bytes."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")
    copies = rows.where(f"octet_length(text) >= {LENGTH}").select("d", "t", F.xxhash64(F.lit(3), "text").alias("t2")).groupBy("t", "t2").agg(F.min("d").alias("rep"), F.count("*").alias("n"))
    copies = written(copies.where("n > 1").orderBy(F.desc("n"), "t", "t2").limit(COPIES).select("t", "t2", "rep"), "copies")
    rows = rows.withColumn("t2", F.xxhash64(F.lit(3), "text")).join(F.broadcast(copies), ["t", "t2"], "left")  # COPIES rows
    rows = rows.withColumn("whole", F.coalesce(F.col("d") > F.col("rep"), F.lit(False))).drop("t2", "rep")
    spans = repeats(rows.where("NOT whole")).groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    found = rows.join(written(spans, "spans"), ["d", "t"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return found.select("doc_id", "text", "whole", "spans").mapInArrow(_kept, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")
