"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments in the shared folder. A segment holds whole documents: for each of its
terms (64-bit hashes of lower-cased words) the ascending, delta-coded positions of every occurrence, and a
directory of its documents. Segments are bounded in bytes, so a term, source or copied text that makes up
a third of the corpus is spread over many of them and nothing is dealt out by term. Positions leave a gap
between documents, so no phrase crosses one.

A query phrase is looked up in every segment: the term with the shortest postings there gives candidate
starts (position less offset), which are intersected with the other terms' offset-adjusted postings, next
rarest first. `proximity` asks instead that each further term occurs within `slop` words of the rarest.

Query phrases are broadcast in chunks of about CHUNK_TERMS terms (flat arrays, about 70 MB); an item of more than
PIECE_WINDOWS windows is cut, so that one long item is spread over chunks too. More chunks are run one after
another, each over all postings, and their hits merged by document, so the benchmark's size is not bounded.

Terms are known by word_hashes, 64 bits that are not linear in the text. Null or wordless texts: no words, no hits;
very long texts are one segment of their own. Items with a null item_id are ignored; repeated items count once. No
items: no hits; no documents: no rows. Every input row keeps its own output row, also with a null or repeated doc_id.
Only doc_id, text and item_id are read; other columns, whatever their names, do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, prepare, runs, spans_of, table, text_bytes, word_hashes, written

WINDOW_WORDS = 13
#: A document is contaminated if hit words are at least one in this many of its words.
HIT_SHARE = 20
CHUNK_TERMS = 1 << 23
SEGMENT = "seg string, doc_ids array<bigint>, doc_words array<bigint>, terms binary, counts binary, postings binary"
HITS = "seg string, doc_no int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and the row of each."""
    data, offs = text_bytes(column)
    data = _LOWER[data]
    starts, ends = runs(_WORD[data], offs)
    rows = np.searchsorted(offs, starts, "right") - 1
    return word_hashes(data, starts, ends), rows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, no = TaskContext.get(), 0
    for batch in blocks(batches, "text", BLOCK_BYTES):
        hashes, rows = words_of(batch.column("text"))
        order = np.argsort(hashes, kind="stable")
        terms, first, counts = np.unique(hashes[order], return_index=True, return_counts=True)
        position = (np.arange(len(hashes)) + rows)[order]
        delta = np.diff(position, prepend=0)
        delta[first] = position[first]
        n_words = np.bincount(rows, minlength=batch.num_rows)
        yield pa.RecordBatch.from_pydict(
            {
                "seg": [f"{task.partitionId()}-{no}"],
                "doc_ids": [batch.column("doc_id").cast(pa.int64()).to_pylist()],
                "doc_words": [n_words.tolist()],
                "terms": [terms.astype("<u8").tobytes()],
                "counts": [counts.astype("<u4").tobytes()],
                "postings": [delta.astype("<u4").tobytes()],
            }
        )
        no += 1


def index(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text), stored in the shared folder."""
    prepare(docs.sparkSession)
    return written(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(_segments, SEGMENT), "postings")


class Segment:
    """One segment, opened: postings by term, all ascending."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        delta = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        sums = np.cumsum(delta)
        base = np.zeros(len(self.terms), np.int64)
        if len(base):
            base = sums[self.first] - delta[self.first]
        self.postings = sums - np.repeat(base, self.counts)
        self.words = np.array(row["doc_words"], np.int64)
        self.span = int(self.words.sum()) + len(self.words) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.span + self.postings
        self.doc_start = np.cumsum(self.words + 1) - (self.words + 1)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms here; -1 for those that do not occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term occurs at a position from low to high."""
        at = np.searchsorted(self.keys, term * self.span + np.maximum(low, 0))
        inside = at < len(self.keys)
        return (high >= 0) & inside & (self.keys[np.where(inside, at, 0)] <= term * self.span + np.minimum(high, self.span - 1))


def matches(seg: Segment, terms: np.ndarray, lens: np.ndarray, slop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of each occurrence; terms is a phrase's hashes by row, lens their number.

    With slop, the start is the rarest term's position, and the others are within slop words of it.
    """
    width = terms.shape[1]
    used = np.arange(width) < lens[:, None]
    local = seg.lookup(terms)
    alive = np.flatnonzero((lens > 0) & ((local >= 0) | ~used).all(axis=1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    local, used = local[alive], used[alive]
    counts = np.where(used, seg.counts[np.where(used, local, 0)], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")
    rarest = np.take_along_axis(local, order[:, :1], 1)[:, 0]
    many = seg.counts[rarest]
    phrase = np.repeat(np.arange(len(alive)), many)
    start = seg.postings[spans_of(many, seg.first[rarest])]
    if slop is None:
        start = start - order[phrase, 0]
    for k in range(1, width):
        more = lens[alive][phrase] > k
        if not more.any():
            break
        at = order[phrase, k]
        ok = ~more
        ask = np.flatnonzero(more)
        if slop is None:
            low = high = start[ask] + at[ask]
        else:  # near and in the same document
            doc = np.searchsorted(seg.doc_start, start[ask], "right") - 1
            low = np.maximum(seg.doc_start[doc], start[ask] - slop)
            high = np.minimum(seg.doc_start[doc] + seg.words[doc] - 1, start[ask] + slop)
        ok[ask] = seg.has(local[phrase[ask], at[ask]], low, high)
        phrase, start = phrase[ok], start[ok]
    return alive[phrase], start


def _search(phrases, slop: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, lens, owner, names = phrases.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                seg = Segment(row)
                n = len(seg.words)
                found, start = matches(seg, terms, lens, slop)
                size = lens[found] if slop is None else np.ones(len(found), np.int64)
                doc = np.searchsorted(seg.doc_start, start, "right") - 1
                edge = np.zeros(seg.span + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                hit = np.cumsum(edge[:-1]) > 0
                lo, hi = runs(hit, np.array([0, len(hit)]))
                at = np.searchsorted(seg.doc_start, lo, "right") - 1
                lo, hi = lo - seg.doc_start[at], hi - seg.doc_start[at]
                cut = np.searchsorted(at, np.arange(n + 1))
                pairs = np.unique(np.stack([doc, owner[found]], 1), axis=0) if len(found) else np.zeros((0, 2), np.int64)
                own = np.searchsorted(pairs[:, 0], np.arange(n + 1))
                as_list = lambda v, kind, c: pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(v, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["seg"]] * n, pa.string()),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(seg.words),
                        as_list(lo.astype(np.int32), pa.int32(), cut),
                        as_list(hi.astype(np.int32), pa.int32(), cut),
                        as_list([names[k] for k in pairs[:, 1].tolist()], pa.string(), own),
                    ],
                    ["seg", "doc_no", "doc_id", "n_words", "starts", "ends", "items"],
                )

    return search


#: Windows of an item that travel together, so that one long item is spread over chunks like any other.
PIECE_WINDOWS = 4096


def _item_words(window: int, piece: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            hashes, rows = words_of(batch.column("text"))
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            many = np.maximum(np.diff(cut) - window + 1, np.minimum(np.diff(cut), 1))  # windows of each item
            pieces = -(-many // piece)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            start = cut[row] + piece * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            size = np.minimum(cut[row + 1], start + piece + window - 1) - start
            offs = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(hashes.view(np.int64)[spans_of(size, start)]))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), lists], ["item", "words"])

    return words


def _phrases(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Distinct windows: hashes by row, lengths, the item of each, and the items' names."""
    rows = rows.combine_chunks()
    items = rows.column("item").to_pylist()
    names = sorted(set(items))
    number = {x: i for i, x in enumerate(names)}
    words = rows.column("words").combine_chunks()
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
    size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    many = np.maximum(size - window + 1, np.minimum(size, 1))
    start = spans_of(many, np.cumsum(size) - size)
    lens = np.minimum(np.repeat(size, many), window)
    owner = np.repeat(np.array([number[x] for x in items], np.int64), many)
    at = start[:, None] + np.arange(window)
    used = np.arange(window) < lens[:, None]
    terms = np.where(used, flat[np.minimum(at, max(len(flat) - 1, 0))], np.uint64(0)) if len(flat) else np.zeros((0, window), np.uint64)
    made = np.ascontiguousarray(np.concatenate([terms, owner[:, None].astype(np.uint64), lens[:, None].astype(np.uint64)], axis=1))
    first = np.unique(made.view([("", np.uint64)] * (window + 2)).ravel(), return_index=True)[1]
    return terms[first], lens[first], owner[first], names


def search(postings: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, slop: int | None = None, chunk_terms: int = CHUNK_TERMS, piece: int = PIECE_WINDOWS) -> DataFrame:
    """For each indexed row its words, the word spans hit by a window of an item, and these items (HITS)."""
    spark = postings.sparkSession
    prepare(spark)
    items = items.where("item_id IS NOT NULL").selectExpr("CAST(item_id AS string) AS item", "text").distinct()
    items = written(items.mapInArrow(_item_words(window, piece), "item string, words array<bigint>"), "phrases")
    total = items.agg(F.sum(F.size("words") * window)).first()[0] or 0
    chunks, found = max(1, -(-total // chunk_terms)), None
    for k in range(chunks):
        rows = items.where(F.expr(f"pmod(xxhash64(item, words), {chunks}) = {k}")).toArrow()
        part = postings.mapInArrow(_search(spark.sparkContext.broadcast(_phrases(rows, window)), slop), HITS)
        found = part if found is None else found.unionByName(part)
    if chunks == 1:
        return found
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    found = found.groupBy("seg", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(spans).alias("s"), both("items").alias("items"))
    return found.mapInArrow(_merged, HITS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the overlapping spans of several chunks."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            joined: list[list[int]] = []
            for x in r.pop("s"):
                if joined and x["starts"] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], x["ends"])
                else:
                    joined.append([x["starts"], x["ends"]])
            r["starts"], r["ends"] = [x for x, _ in joined], [y for _, y in joined]
        kinds = {"seg": pa.string(), "doc_no": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, share: int = HIT_SHARE) -> DataFrame:
    """For each row of docs: n_words, n_hit, the items found, their digest, and whether it is contaminated."""
    found = search(index(docs), items, window)
    n_hit = F.expr("aggregate(zip_with(starts, ends, (s, e) -> e - s), 0L, (a, x) -> a + x)")
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "items",
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW_WORDS}) AS n, array_to_string(w[i : i + {WINDOW_WORDS - 1}], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW_WORDS - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item FROM grams g JOIN windows x ON x.s = g.s AND x.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
per AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN per USING (doc_id)
"""
