"""Token-id files: a static range asymmetric numeral system over independent interleaved blocks.

Documents are range-sorted by id and tokenized; each task rolls files of about FILE_TOKENS tokens. One
frequency table a file is shared by its blocks. A block holds whole documents and is coded by interleaved
lanes: symbol i belongs to lane i mod lanes, each lane is a 64-bit rANS state that is renormalised by
32-bit words. The footer has a checkpoint for each block (offset, size, lanes, tokens, documents, CRC-32),
from which any block is decoded alone; files are written under temporary names and renamed, and the
manifest, a table, lists those of successful attempts.

File: MAGIC | frequency table | block payloads | zlib(footer) | footer offset u64, footer crc u32 | MAGIC.
Block: final lane states u64[lanes] | words u32[...] in the order in which a decoder takes them.

Null text is empty and gives the end id alone. Ids of one doc_id are ordered by the text's hash; rows
with a null doc_id come first. An empty table gives no file. Very long texts are encoded whole and are a block of
their own. Only doc_id and text are read; other columns, whatever their names, do not travel.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import blocks, prepare, runs, spans_of, table, text_bytes, word_hashes, work_dir, written

MAGIC = b"RANSTOK1"
END_ID = 2
FILE_TOKENS, BLOCK_TOKENS, LANES = 1 << 23, 1 << 19, 2048
LOW = np.uint64(1 << 31)
#: Tasks that read blocks back, at most.
MOST_TASKS = 1 << 14
#: Characters that Python and the tokenizer may not both take as white space.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
MANIFEST = "part int, no int, file string, block int, offset long, size long, lanes int, n_tokens long, n_docs long, crc long"


class Table:
    """Symbols with frequencies that add up to 2**bits, each at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.bits = symbols.astype(np.uint32), bits
        self.freqs = freqs.astype(np.uint64)
        self.cum = np.cumsum(self.freqs) - self.freqs

    @classmethod
    def fit(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        bits = min(28, max(12, int(len(symbols)).bit_length() + 4))
        total, scale = int(counts.sum()), 1 << bits
        freqs = np.maximum(1, counts.astype(np.float64) * scale / max(total, 1)).astype(np.int64)
        over = int(freqs.sum()) - scale
        if over < 0:
            freqs[np.argmax(freqs)] -= over
        while over > 0:  # taken from the largest, which lose least by it
            order = np.argsort(-freqs, kind="stable")[: max(1, len(freqs) // 8)]
            take = np.minimum(np.maximum(freqs[order] // 16, 1), freqs[order] - 1)
            take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
            freqs[order] -= take
            over -= int(take.sum())
        return cls(symbols, freqs, bits)

    def to_bytes(self) -> bytes:
        raw = zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes(), 6)
        return struct.pack("<III", self.bits, len(self.symbols), len(raw)) + raw

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        bits, n, size = struct.unpack_from("<III", data)
        raw = np.frombuffer(zlib.decompress(data[12 : 12 + size]), "<u4")
        return cls(np.cumsum(raw[:n], dtype=np.uint32), raw[n:], bits)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))


def encode_block(ranks: np.ndarray, tab: Table, lanes: int) -> bytes:
    """Codes symbol numbers; the last row of lanes may be short."""
    state, rows, out = np.full(lanes, LOW, np.uint64), -(-len(ranks) // lanes), []
    f_all, c_all = tab.freqs[ranks], tab.cum[ranks]
    shift, down = np.uint64(63 - tab.bits), np.uint64(32)
    bits = np.uint64(tab.bits)
    for r in range(rows - 1, -1, -1):
        f, c = f_all[r * lanes : (r + 1) * lanes], c_all[r * lanes : (r + 1) * lanes]
        x = state[: len(f)]
        full = np.flatnonzero(x >= f << shift)
        out.append(x[full].astype(np.uint32))
        x[full] >>= down
        q = x // f
        x[:] = (q << bits) + (x - q * f) + c
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_block(data: bytes, n: int, tab: Table, lanes: int, slots: np.ndarray) -> np.ndarray:
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words, at = np.frombuffer(data, "<u4", offset=8 * lanes), 0
    ranks = np.empty(n, np.uint32)
    bits, mask, up = np.uint64(tab.bits), np.uint64((1 << tab.bits) - 1), np.uint64(32)
    for lo in range(0, n, lanes):
        x = state[: min(lanes, n - lo)]
        slot = x & mask
        s = slots[slot]
        ranks[lo : lo + len(x)] = s
        x[:] = tab.freqs[s] * (x >> bits) + slot - tab.cum[s]
        few = np.flatnonzero(x < LOW)
        x[few] = (x[few] << up) | words[at : at + len(few)]
        at += len(few)
    if at != len(words) or (state != LOW).any():
        raise ValueError("the block does not decode to its end")
    return ranks


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


class Words:
    """Ids of white-space-separated words, known by their 64-bit hash, in flat arrays.

    Where the vocabulary marks the ends of pre-tokenized pieces (end_of_word_suffix), a word's new pieces
    are encoded many at a time, as one text of pieces between blanks, and told apart by these marks; words
    beyond plain Latin characters and other vocabularies are encoded word by word.
    """

    #: Words (about 30 bytes each) and pieces that a worker remembers; beyond, it starts anew.
    LIMIT, PIECES = 3_000_000, 400_000
    _PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+").fullmatch

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self._forget()
        made = json.loads(self.tokenizer.to_str())
        steps = [made["normalizer"], *(made["normalizer"] or {}).get("normalizers", [])] if made["normalizer"] else []
        first = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        suffix = made["model"].get("end_of_word_suffix")
        cuts = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
        self.split = None
        if suffix and cuts and {"NFC", "Replace", "Lowercase"} == {s["type"] for s in steps} - {"Sequence"}:
            self.split = regex.compile(first["pattern"]["Regex"]).findall
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        for lo in range(0, len(pieces), 2000):
            part = pieces[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw = ids.tobytes()
                cut = (4 * ends).tolist()
                self.pieces.update(zip(part, (raw[a:b] for a, b in zip([0, *cut], cut, strict=False)), strict=True))
            else:
                self.pieces.update(zip(part, self._encoded(part), strict=True))

    def _forget(self) -> None:
        self.keys, self.at, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.number = np.zeros(0, np.int64)

    def _ids(self, new: list[str]) -> list[bytes]:
        if self.split is None:
            return list(self._encoded(new))
        plain = [i for i, w in enumerate(new) if self._PLAIN(w) and "<|" not in w]
        rest = sorted(set(range(len(new))).difference(plain))
        found: list[bytes] = [b""] * len(new)
        for i, ids in zip(rest, self._encoded([new[i] for i in rest]), strict=True):
            found[i] = ids
        cut = [self.split(new[i].lower()) for i in plain]
        if len(self.pieces) > self.PIECES:  # short ones come again most
            self.pieces = {p: x for p, x in self.pieces.items() if len(p) <= 8}
            if len(self.pieces) > self.PIECES // 2:
                self.pieces = {}
        self._learn(list(set().union(*cut) - self.pieces.keys()))
        get = self.pieces.__getitem__
        for i, p in zip(plain, cut, strict=True):
            found[i] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))
        return found

    def _add(self, keys: np.ndarray, new: list[str]) -> None:
        """Takes in new words and their hashes."""
        found: list[bytes] = []
        for lo in range(0, len(new), 20_000):
            found += self._ids(new[lo : lo + 20_000])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = np.arange(len(self.at) - 1, len(self.at) - 1 + len(new))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(found), "<u4")))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, place, keys), np.insert(self.number, place, number)

    def ids(self, column: pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id. No token of this kind of vocabulary spans white space, so words
        are encoded once each; a text with other white space than blank, tab and line ends goes whole."""
        if len(self.keys) > self.LIMIT:
            self._forget()
        data, offs = text_bytes(column)
        odd = [i for i, t in enumerate(column.to_pylist()) if t and _ODD.search(t)]
        starts, ends = runs(~_SPACE[data], offs)
        row = np.searchsorted(offs, starts, "right") - 1
        if odd:
            keep = ~np.isin(row, odd)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        keys, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(keys):
            place = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == keys[inside]
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            cut = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._add(keys[new], [raw[a:b].decode() for a, b in cut])
            number = self.number[np.searchsorted(self.keys, keys)][inverse]
            at, sizes = self.at[number], self.at[number + 1] - self.at[number]
        else:
            at = sizes = np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(row, np.arange(len(column) + 1))]
        flat = np.insert(self.flat[spans_of(sizes, at)], total[1:], np.uint32(end_id))
        out = np.split(flat, (total[1:] + np.arange(1, len(column) + 1))[:-1])
        for i in odd:
            out[i] = np.frombuffer(next(self._encoded([column[i].as_py()])) + np.array([end_id], "<u4").tobytes(), "<u4")
        return out


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """One cache for all tasks of a worker."""
    return Words(path)


def _file(docs: list[tuple[int | None, np.ndarray]]) -> tuple[bytes, list[dict]]:
    """One file of (doc_id, uint32 ids) and its checkpoints."""
    ids = np.concatenate([x for _, x in docs])
    sizes = np.array([len(x) for _, x in docs], np.int64)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    tab = Table.fit(symbols, counts[symbols])
    rank = np.zeros(len(counts), np.uint32)
    rank[symbols] = np.arange(len(symbols), dtype=np.uint32)
    head = MAGIC + tab.to_bytes()
    ends, out, points, lo, first = np.cumsum(sizes), [head], [], 0, 0
    at = len(head)
    while lo < len(docs):
        hi = max(lo + 1, int(np.searchsorted(ends, first + BLOCK_TOKENS, "right")))
        n = int(ends[hi - 1]) - first
        lanes = min(LANES, max(1, n // 64))
        raw = encode_block(rank[ids[first : first + n]], tab, lanes)
        points.append({"offset": at, "size": len(raw), "lanes": lanes, "n_tokens": n, "n_docs": hi - lo, "crc": zlib.crc32(raw)})
        out.append(raw)
        at, lo, first = at + len(raw), hi, first + n
    known = np.array([x is not None for x, _ in docs])
    numbers = np.array([x or 0 for x, _ in docs], "<i8")
    foot = zlib.compress(json.dumps(points).encode() + b"\n" + numbers.tobytes() + known.tobytes() + sizes.astype("<i8").tobytes(), 6)
    out += [foot, struct.pack("<QI", at, zlib.crc32(foot)), MAGIC]
    return b"".join(out), points


def _footer(data: bytes) -> tuple[list[dict], list[int | None], np.ndarray]:
    points, _, rest = zlib.decompress(data).partition(b"\n")
    n = len(rest) // 17
    numbers, known = np.frombuffer(rest, "<i8", n), np.frombuffer(rest, bool, n, 8 * n)
    return json.loads(points), [x if k else None for x, k in zip(numbers.tolist(), known.tolist(), strict=True)], np.frombuffer(rest[9 * n :], "<i8", n)


def _writer(root: str, path: str, end_id: int, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        words, part = _words(path), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        no = size = 0

        def flush() -> pa.RecordBatch:
            data, points = _file(held)
            name = f"part-{part:06d}-{no:05d}.rans"
            files.write(root, name, data)
            rows = [{"part": part, "no": no, "file": name, "block": k} | p for k, p in enumerate(points)]
            kinds = {"part": pa.int32(), "no": pa.int32(), "file": pa.string(), "block": pa.int32(), "offset": pa.int64(), "size": pa.int64(), "lanes": pa.int32(), "n_tokens": pa.int64(), "n_docs": pa.int64(), "crc": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

        for batch in blocks(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.ids(batch.column("text"), end_id), strict=True):
                held.append((doc_id, ids))
                size += len(ids)
                if size >= file_tokens:
                    yield flush()
                    held, no, size = [], no + 1, 0
        if held:
            yield flush()

    return write


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, root: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order; returns the manifest with the first token of each block.

    The manifest has a row a block. First tokens are prefix sums in two levels: of the tasks' totals (one number a task)
    on the driver, and of the blocks of each task.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = files.resolved(spark, root or work_dir(spark, "tokens"))
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text", "xxhash64(text) AS h").repartitionByRange("doc_id", "h")
    rows = rows.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = written(rows.mapInArrow(_writer(root, path, end_id, file_tokens), MANIFEST), "manifest")
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *(r.n for r in totals)]).tolist()
    first = spark.createDataFrame([(r.part, s) for r, s in zip(totals, starts, strict=False)], "part int, part_start long")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("no", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, *keys: F.coalesce(F.sum(c).over(before(*keys)), F.lit(0))
    manifest = manifest.select("*", sums("n_tokens", "part").alias("t"), sums("n_docs", "part", "no").alias("first_doc")).join(F.broadcast(first), "part")  # a row a task
    return manifest.select("*", (F.col("part_start") + F.col("t")).alias("start"), F.lit(root).alias("root")).drop("t", "part_start")


@lru_cache(maxsize=2)
def _opened(root: str, name: str) -> tuple[Table, np.ndarray, list[int | None], np.ndarray]:
    """The table, its slots, document ids and sizes of one file, checked."""
    offset, crc = struct.unpack("<QI", files.read(root, name, -12 - len(MAGIC))[:12])
    foot = files.read(root, name, offset)[: -12 - len(MAGIC)]
    if zlib.crc32(foot) != crc:
        raise ValueError(f"{name}: the footer is damaged")
    points, numbers, sizes = _footer(foot)
    head = files.read(root, name, 0, points[0]["offset"])
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{name}: not a token file")
    tab = Table.from_bytes(head[len(MAGIC) :])
    return tab, tab.slots(), numbers, sizes


def read_block(root: str, name: str, point: dict) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their token counts and all token ids of one block."""
    tab, slots, numbers, sizes = _opened(root, name)
    data = files.read(root, name, point["offset"], point["size"])
    if zlib.crc32(data) != point["crc"]:
        raise ValueError(f"{name}: block {point['block']} is damaged")
    ids = tab.symbols[decode_block(data, point["n_tokens"], tab, point["lanes"], slots)]
    lo = point["first_doc"]
    return numbers[lo : lo + point["n_docs"]], sizes[lo : lo + point["n_docs"]], ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            numbers, sizes, ids = read_block(r["root"], r["file"], r)
            ends, raw = np.cumsum(sizes), ids.astype("<u4").tobytes()
            cut = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)
            view = memoryview(raw)
            crc = [zlib.crc32(view[a:b]) for a, b in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(r["start"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: start, n_tokens and the CRC-32 of its ids. Every block decodes alone."""
    prepare(manifest.sparkSession)
    tasks = min(MOST_TASKS, max(1, manifest.count() // 4))  # given outright: the manifest's bytes say nothing of the work
    return manifest.repartitionByRange(tasks, "file", "block").sortWithinPartitions("file", "block").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes and reads back; path is the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(written(write_tokens(docs, path, end_id), "manifest"))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
