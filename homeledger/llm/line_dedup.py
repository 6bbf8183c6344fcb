"""Line dedup by a deletion-neighbourhood join over words, in DataFrame functions only.

Lines are cut at \\n and compared by their words. A line is removed if an earlier line (by doc_id, then
line number, all over the corpus, judged on the input) has the same words, or is within an edit bound of
one word inserted, deleted or replaced. The first holds for lines of EXACT_WORDS words or more, that is all but blank
ones, the second where the longer line has NEAR_WORDS or more: in a shorter one a word is no small edit.

1. Equal lines meet by a 128-bit hash; partial minima keep the earliest, so a line that a third of the
   documents share is summed up before it moves.
2. Of the distinct lines, those that share no half with another one are set aside: a line within one edit
   of another agrees with it on the first half of its words or on the rest. This loses none.
3. The rest emit all variants within the bound (each word deleted, and the line itself) as hashed keys;
   equal keys are joined through the earliest line of each key, never as pairs of a group.
4. Each pair found is verified on its words; if a hash was equal by chance, the other lines of the key are
   tried.

Order of rows: doc_id (nulls last), then the text's hash for rows with the same doc_id; whole repeated rows
are one document. Null text has one empty line. Every input row keeps one output row; an empty table gives none. Very
long texts are lines like any others. Only doc_id and text are read; other columns do not travel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

EXACT_WORDS, NEAR_WORDS = 1, 8
#: Bits of the bitmap of halves that different lines share (16 MB); above a quarter as many, they are joined.
BITS = 27
_LAST = (1 << 63) - 1


def lines(docs: DataFrame) -> DataFrame:
    """(pos, line) of every line; pos orders the corpus."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("d", "t", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    return rows.select(F.struct("d", "t", "l").alias("pos"), "line")


def _words(line: str) -> Column:
    return F.split(line, " ")


def hashed(rows: DataFrame) -> DataFrame:
    """Lines (as s: words and single blanks) of enough words with their hashes: h1, h2 of all words, and of the halves.

    halves: for M of n and n - 1 words, a hash of the first M div 2 words and one of the last M - M div 2.
    """
    held = [F.contains("line", F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")]
    untidy = reduce(lambda a, b: a | b, held, F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" ")))
    tidy = F.when(untidy, F.btrim(F.regexp_replace("line", "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))).otherwise(F.col("line"))
    rows = _once(rows, tidy.alias("s"), F.lit(None).alias("_")).select("pos", "s")
    rows = _once(rows, F.split("s", " ").alias("w"), F.lit(None).alias("_")).select("pos", "s", "w")
    rows = rows.withColumn("n", F.when(F.col("s") == "", 0).otherwise(F.size("w"))).where(F.col("n") >= EXACT_WORDS)
    half = lambda m: ((m, 0, "1", f"({m}) div 2"), (m, 1, f"n - (({m}) - ({m}) div 2) + 1", f"({m}) - ({m}) div 2"))
    parts = [f"xxhash64({m}, {k}, slice(w, CAST({a} AS int), CAST({b} AS int)))" for x in ("n", "n - 1") for m, k, a, b in half(x)]
    halves = F.expr(f"CASE WHEN n >= {NEAR_WORDS - 1} THEN array({', '.join(parts)}) END")
    rows = _once(rows, F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), halves.alias("halves"))
    return rows.select("pos", "n", "h1", "h2", "halves", "s")


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, however often they are used: a generator of one row
    keeps the optimiser from copying their expressions to each use."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _held(rows: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """rows (halves) with front and back: whether a first or a last half may be among keys (half).

    Where the keys are few, a bitmap of 2**bits bits says so (broadcast, of fixed size; false positives only cost
    time); else a join.
    """
    if keys.count() <= (1 << bits) // 4:
        x = F.col("half").bitwiseAND((1 << bits) - 1)
        maps = keys.select(x.alias("x")).select(F.expr("CAST(shiftright(x, 15) AS int)").alias("part"), F.expr("x & 32767").alias("bit"))
        maps = maps.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
        hits = []
        for j in range(4):
            rows = rows.withColumn("x", F.col("halves")[j].bitwiseAND((1 << bits) - 1)).withColumn("part", F.expr("CAST(shiftright(x, 15) AS int)"))
            rows = rows.join(F.broadcast(maps), "part", "left")
            byte = F.expr("CAST(conv(hex(substring(map, CAST((x & 32767) / 8 AS int) + 1, 1)), 16, 10) AS int)")
            rows = rows.withColumn(f"hit{j}", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(x & 7 AS int))")) != 0, F.lit(False))).drop("x", "part", "map")
            hits.append(f"hit{j}")
        return rows.withColumn("front", F.col(hits[0]) | F.col(hits[2])).withColumn("back", F.col(hits[1]) | F.col(hits[3])).drop(*hits)
    own = rows.select("pos", F.posexplode("halves").alias("j", "half")).join(keys, "half")
    own = own.groupBy("pos").agg(F.max(F.col("j") % 2 == 0).alias("front"), F.max(F.col("j") % 2 == 1).alias("back"))
    return rows.join(own, "pos")


def variants(rows: DataFrame) -> DataFrame:
    """(k, i, pos) for rows (pos, w, n, front, back): the key of the line without its word i; i = -1: the whole line.

    Only words that can differ are deleted: those behind a shared front half, or before a shared back half.
    A key mixes the exclusive-ors of the word hashes and of the hashes of neighbouring words, so that each
    variant takes constant time; equal sequences have equal keys.
    """
    rows = rows.withColumn("e", F.concat(F.array(F.lit("\x01")), "w", F.array(F.lit("\x02"))))
    rows = rows.withColumn("g", F.expr("zip_with(e, slice(e, 2, n + 1), (a, b) -> CASE WHEN b IS NOT NULL THEN xxhash64(a, b) END)"))
    rows = rows.withColumn("skip", F.expr("zip_with(e, slice(e, 3, n), (a, c) -> CASE WHEN c IS NOT NULL THEN xxhash64(a, c) END)"))
    rows = rows.withColumn("b", F.expr("aggregate(slice(g, 1, n + 1), 0L, (a, x) -> a ^ x)"))
    rows = rows.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).withColumn("a", F.expr("aggregate(h, 0L, (a, x) -> a ^ x)"))
    rows = rows.withColumn("m", F.expr("zip_with(zip_with(g, slice(g, 2, n), (x, y) -> x ^ y), slice(skip, 1, n), (x, y) -> x ^ y)"))
    rows = rows.withColumn("v", F.expr("transform(zip_with(h, slice(m, 1, n), (x, y) -> struct(x AS x, y AS y)), (z, i) -> struct(xxhash64(a ^ z.x, b ^ z.y, n - 1) AS k, i AS i))"))
    near = "(front AND x.i >= (n - 1) div 2) OR (back AND x.i <= n div 2)"
    some = F.expr(f"concat(array(struct(xxhash64(a, b, n) AS k, -1 AS i)), CASE WHEN n >= {NEAR_WORDS} THEN filter(v, x -> {near}) ELSE array() END)")
    return rows.select("pos", F.explode(some).alias("x")).select("x.k", "x.i", "pos")


def _within(a: str, b: str) -> Column:
    """Whether word arrays differ by at most one word, and neither is too short."""
    n, m = f"size({a})", f"size({b})"
    head = f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0) - 1, least({n}, {m}))"
    tail = f"coalesce(nullif(array_position(zip_with(reverse({a}), reverse({b}), (x, y) -> x <=> y), false), 0) - 1, least({n}, {m}))"
    return F.expr(f"greatest({n}, {m}) >= {NEAR_WORDS} AND abs({n} - {m}) <= 1 AND least({head}, least({n}, {m})) + least({tail}, least({n}, {m})) >= greatest({n}, {m}) - 1")


def removed_lines(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(pos, near) of each line that is removed; near: it has no equal earlier line."""
    whole = hashed(lines(docs))
    narrow = written(whole.drop("s"), "lines")
    again = narrow.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    again = written(narrow.select("pos", "h1", "h2").join(again, ["h1", "h2"]), "lines-equal")
    first = again.groupBy("h1", "h2").agg(F.min("pos").alias("first"))
    exact = again.join(first, ["h1", "h2"]).where("first < pos").select("pos", F.lit(False).alias("near"))

    halves = narrow.where("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
    shared = written(shared, "lines-halves")

    rows = _held(whole.where("halves IS NOT NULL"), shared, bits).where("front OR back")
    rows = rows.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.first("s").alias("s"), F.max("front").alias("front"), F.max("back").alias("back"))
    rows = written(rows.select("pos", "front", "back", _words("s").alias("w")).withColumn("n", F.size("w")), "lines-near")

    # the earliest line of each key and deleted word, then of each key
    keys = variants(rows)
    least = written(keys.groupBy("k", "i").agg(F.min("pos").alias("m"), F.max("pos").alias("z")), "lines-keys")
    by_key = least.groupBy("k").agg(F.min(F.when(F.col("i") == -1, F.col("m"))).alias("whole"), F.min("m").alias("any"), F.max("z").alias("last")).where("any <> last")
    best = least.join(by_key, "k").select("k", "i", F.expr("CASE WHEN i = -1 THEN any ELSE least(m, whole) END").alias("other"))
    pairs = written(keys.join(best, ["k", "i"]).where("other < pos").select("k", "i", "pos", "other"), "lines-pairs")

    text = rows.select("pos", "w")
    other = text.selectExpr("pos AS other", "w AS v")
    tried = pairs.join(text, "pos").join(other, "other").select("k", "i", "pos", _within("w", "v").alias("ok"))
    tried = written(tried, "lines-tried")
    near = tried.where("ok").select("pos")
    failed = tried.where("NOT ok").select("k", "i", "pos").join(near.distinct(), "pos", "left_anti")
    if not failed.isEmpty():  # equal hashes by chance: any earlier line of the key will do
        failed = failed.select("k", F.col("i").alias("own"), "pos").join(keys.selectExpr("k", "i", "pos AS other"), "k").where("other < pos AND (i = own OR i = -1 OR own = -1)")
        failed = failed.join(text, "pos").join(other, "other").where(_within("w", "v"))
        near = near.unionByName(failed.select("pos"))
    near = near.distinct().withColumn("near", F.lit(True))
    return exact.distinct().unionByName(near).groupBy("pos").agg(F.min("near").alias("near"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, removed) for each row; removed: line numbers from 0, ascending."""
    gone = removed_lines(docs).select("pos.d", "pos.t", "pos.l", "near").groupBy("d", "t").agg(
        F.array_sort(F.collect_list("l")).alias("removed"), F.count(F.when(~F.col("near"), 1)).alias("n_exact"), F.count(F.when(F.col("near"), 1)).alias("n_near")
    )
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), F.expr("CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\n', '')) + 1 AS bigint)").alias("n_lines"))
    found = own.join(gone, ["d", "t"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_lines", zero("n_exact"), zero("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with their removed lines taken out of the text; found: the result of line_dedup, unique doc_ids."""
    kept = F.expr("array_join(transform(filter(transform(split(text, '\n'), (x, i) -> struct(x AS x, i AS i)), z -> NOT array_contains(removed, z.i)), z -> z.x), '\n')")
    few = found.where("size(removed) > 0").selectExpr("doc_id AS removed_from", "removed")
    return docs.join(few, docs.doc_id == few.removed_from, "left").withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)).drop("removed", "removed_from")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


ORACLE = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS l FROM documents),
line AS (SELECT row_number() OVER (ORDER BY doc_id, l) AS p, doc_id, l, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM raw),
u AS (SELECT p, doc_id, l, w, len(w) AS n, array_to_string(w, ' ') AS s FROM line WHERE len(w) >= {EXACT_WORDS}),
f AS (SELECT s, n, any_value(w) AS w, min(p) AS first FROM u GROUP BY s, n),
v AS (
  SELECT first, s AS k, -1 AS i FROM f WHERE n >= {NEAR_WORDS - 1}
  UNION ALL
  SELECT first, array_to_string(list_concat(w[1 : j], w[j + 2 : n]), ' ') AS k, j AS i FROM (SELECT first, w, n, unnest(range(n)) AS j FROM f WHERE n >= {NEAR_WORDS})),
ki AS (SELECT k, i, min(first) AS m FROM v GROUP BY k, i),
kk AS (SELECT k, min(m) AS any_m, min(m) FILTER (WHERE i = -1) AS whole FROM ki GROUP BY k),
near AS (
  SELECT DISTINCT v.first AS p FROM v JOIN ki USING (k, i) JOIN kk USING (k)
  WHERE CASE WHEN v.i = -1 THEN any_m ELSE least(ki.m, coalesce(whole, ki.m)) END < v.first),
gone AS (
  SELECT u.doc_id, u.l, u.p = f.first AS near FROM u JOIN f USING (s, n) WHERE u.p > f.first OR u.p IN (SELECT p FROM near)),
g AS (SELECT doc_id, count(*) FILTER (WHERE NOT near) AS n_exact, count(*) FILTER (WHERE near) AS n_near, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
