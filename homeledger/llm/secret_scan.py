"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived (an OR of ANDs of trigrams that
every match must hold, in lower case). The index has, for each trigram that some query asks for, its
posting lists: keys (64-bit hashes) of the texts that hold it, cut into buckets of bounded length. A
query intersects the lists of each of its ANDs and unites the results. Candidates come back to the texts as
bitmaps of 2**BITS bits a rule (broadcast, of fixed size) or, where they are many, by a join on the key;
false positives cost time only, because every candidate is verified by the regular expression itself.
Rules without a mandatory trigram scan every text.

Postings are keyed by text, so any number of copies is one posting, and nothing depends on doc_id: every
input row keeps one output row, also for repeated or null doc_ids. Null text is empty. Positions are code
points, end exclusive; matches of a rule are leftmost and do not overlap, failing ones are dropped. An empty table gives
no rows; very long texts are scanned whole. Only doc_id and text are read; other columns do not travel.

The index here holds the trigrams that the rules at hand ask for, found in one pass over the texts: it is made for a set of
rules, not kept for later ones.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Bits of a rule's candidate bitmap (1 MB); above a quarter as many candidates they are joined instead.
BITS = 23
#: Texts to a bucket of postings, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if they have least code points and, where group is set, its text has group_least."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    group_least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # as [0-9a-f]+ of 24 or more: a match is a whole run either way
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])
#: Strings that a part of a pattern is spelled out into at most; beyond, what is known so far is used.
_SPELLED = 64


def _absorbed(q: set[frozenset[str]]) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _both(a: Query, b: Query) -> Query:
    return _absorbed({x | y for x, y in product(a, b)})


def _of(strings: set[str]) -> Query:
    """What a text holding one of the strings must hold."""
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) if strings else _ANY


def _chars(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is parser.LITERAL:
            found.add(chr(arg).lower())
        elif op is parser.RANGE and arg[1] - arg[0] < 12:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 12 else None


def _walk(items, known: set[str], query: Query) -> tuple[set[str], Query]:
    """known: all strings that may end here, since the last part that could not be spelled out."""
    for op, arg in items:
        more: set[str] | None = None
        if op is parser.LITERAL:
            more = {chr(arg).lower()}
        elif op is parser.IN:
            more = _chars(arg)
        elif op is parser.SUBPATTERN:
            known, query = _walk(arg[-1], known, query)
            continue
        elif op is parser.AT:
            continue
        elif op is parser.BRANCH:
            ends = [_walk(x, {""}, _ANY) for x in arg[1]]
            if all(q == _ANY for _, q in ends):
                more = set().union(*(s for s, _ in ends))
            else:
                either = _absorbed(set().union(*(_both(q, _of(s)) for s, q in ends)))
                known, query = {""}, _both(_both(query, _of(known)), either)
                continue
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            low, high, part = arg
            one, inner = _walk(part, {""}, _ANY)
            if inner == _ANY and one != {""} and high is not parser.MAXREPEAT and high <= 3 and len(one) ** int(high) <= _SPELLED:
                more = {"".join(x) for n in range(low, int(high) + 1) for x in product(one, repeat=n)}
            elif low and inner == _ANY and one != {""}:
                known, query = {""}, _both(query, _of({a + b for a in known for b in one} if len(known) * len(one) <= _SPELLED else known))
                continue
        if more is None or len(known) * len(more) > _SPELLED:
            query = _both(query, _of(known))
            known = more if more is not None else {""}
        else:
            known = {a + b for a in known for b in more}
    return known, query


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of lower-case trigrams; one empty AND where none is mandatory."""
    known, query = _walk(parser.parse(pattern), {""}, _ANY)
    query = _both(query, _of(known))
    # a trigram with an upper-case or non-ASCII form that lower() may change is no evidence
    return _absorbed({frozenset(t for t in x if t.isascii()) for x in query})


KEY = "xxhash64(t)"


def index(texts: DataFrame, vocabulary: list[str], n: int | None = None) -> DataFrame:
    """Posting lists (tri, bucket, keys) of the texts in column t, stored in the shared folder."""
    n = texts.count() if n is None else n
    held = texts.select(F.expr(KEY).alias("key"), F.lower("t").alias("lt"))
    some = F.array_compact(F.array(*(F.when(F.contains("lt", F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary))))
    rows = held.select("key", F.explode(some).alias("tri"))
    rows = rows.select("tri", F.expr(f"pmod(key, {max(1, n // BUCKET_ROWS)})").alias("bucket"), "key")
    return written(rows.groupBy("tri", "bucket").agg(F.collect_set("key").alias("keys")), "trigrams")


def candidates(postings: DataFrame, vocabulary: list[str], queries: dict[str, Query]) -> DataFrame:
    """(kind, key) of the texts that satisfy each rule's trigram query, by intersection of posting lists."""
    number = {g: i for i, g in enumerate(vocabulary)}
    lists = postings.groupBy("bucket").agg(*(F.first(F.when(F.col("tri") == i, F.col("keys")), ignorenulls=True).alias(f"p{i}") for i in range(len(vocabulary))))
    none = F.lit(None).cast("array<bigint>")

    def met(clause: frozenset[str]) -> Column:
        found = None
        for g in sorted(clause):
            p = F.coalesce(F.col(f"p{number[g]}"), F.array().cast("array<bigint>"))
            found = p if found is None else F.array_intersect(found, p)
        return found if found is not None else none

    each = [F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.flatten(F.array(*map(met, sorted(q, key=sorted))))).alias("keys")) for kind, q in queries.items()]
    return lists.select(F.explode(F.array(*each)).alias("x")).select("x.kind", F.explode("x.keys").alias("key"))


def _flagged(texts: DataFrame, found: DataFrame, kinds: list[str], bits: int) -> DataFrame:
    """texts with a Boolean c_<kind> for each rule: whether it may match."""
    if found.count() <= (1 << bits) // 4:
        place = F.expr(f"pmod(key, {1 << bits})")
        rows = found.select("kind", (place / 32768).cast("int").alias("part"), (place % 32768).alias("bit"))
        maps = rows.groupBy("part").agg(*(F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE kind = '{k}')").alias(f"m_{k}") for k in kinds))
        texts = texts.withColumn("place", F.expr(f"pmod({KEY}, {1 << bits})"))
        texts = texts.withColumn("part", (F.col("place") / 32768).cast("int")).join(F.broadcast(maps), "part", "left")  # at most 2**bits bits a rule
        byte = lambda k: F.expr(f"CAST(conv(hex(substring(m_{k}, CAST((place % 32768) / 8 AS int) + 1, 1)), 16, 10) AS int)")
        bit = lambda k: F.coalesce(byte(k).bitwiseAND(F.expr("shiftleft(1, CAST(place % 8 AS int))")) != 0, F.lit(False))
        return texts.select("*", *(bit(k).alias(f"c_{k}") for k in kinds)).drop("place", "part", *(f"m_{k}" for k in kinds))
    sets = found.groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    texts = texts.withColumn("key", F.expr(KEY)).join(sets, "key", "left")
    return texts.select("*", *(F.coalesce(F.array_contains("kinds", k), F.lit(False)).alias(f"c_{k}") for k in kinds)).drop("key", "kinds")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(rule: Rule, no: int) -> Column:
    """array<struct<s, k, e, kind>> of the rule's matches in t: lengths of the pieces between matches and of
    the matches, added up."""
    p = _quoted(rule.pattern)
    gaps = f"transform(split(t, {p}, -1), x -> char_length(x))"
    hits = f"transform(regexp_extract_all(t, {p}, 0), x -> char_length(x))"
    group = f"transform(regexp_extract_all(t, {p}, {rule.group}), x -> char_length(x))" if rule.group else "CAST(array() AS array<int>)"
    pairs = f"zip_with(zip_with({gaps}, {hits}, (a, b) -> struct(a AS gap, b AS n)), {group}, (x, g) -> struct(x.gap AS gap, x.n AS n, coalesce(g, 0) AS g))"
    kind = "array<struct<s:int,k:int,e:int,kind:string>>"
    one = f"array(struct(a.at + x.gap AS s, {no} AS k, a.at + x.gap + x.n AS e, '{rule.kind}' AS kind))"
    step = f"struct(a.at + x.gap + coalesce(x.n, 0) AS at, CASE WHEN x.n >= {rule.least} AND x.g >= {rule.group_least} THEN concat(a.found, CAST({one} AS {kind})) ELSE a.found END AS found)"
    return F.expr(f"aggregate({pairs}, struct(0 AS at, CAST(array() AS {kind}) AS found), (a, x) -> {step}, a -> a.found)")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, bits: int = BITS) -> DataFrame:
    """(doc_id, spans) for each row: all matches of all rules by start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    vocabulary = sorted({g for q in indexed.values() for x in q for g in x})
    rows = texts
    if indexed:
        found = written(candidates(index(texts, vocabulary), vocabulary, indexed), "secrets")
        rows = _flagged(texts, found, list(indexed), bits)
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int,kind:string>>)")
    each = [F.when(F.col(f"c_{r.kind}") if r.kind in indexed else F.expr(f"rlike(t, {_quoted(r.pattern)})"), spans(r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select("doc_id", F.sort_array(F.concat(*each)).alias("spans"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    text = lambda some: f"array_join(transform({some}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    base = F.sha2(F.expr(text(f"filter(spans, x -> x.k < {len(BASE)})")), 256).alias("base_sha256")
    return found.select("doc_id", *(count(r.kind) for r in BASE), base, F.expr(text("spans")).alias("spans"))


def _oracle() -> str:
    letters = "".join
    both = lambda w: letters(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(map(both, ("password", "passwd", "secret", "token", "api_?key")))
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern if i else f"""({words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        p = p.replace("'", "''")
        least = f"length(ms[i]) >= {r.least}" + (f" AND length(regexp_extract(ms[i], '{p}', {r.group})) >= {r.group_least}" if r.group else "")
        parts.append(
            f"SELECT n, {i} AS k, '{r.kind}' AS kind, CAST(pos AS BIGINT) AS s, CAST(pos + length(ms[i]) AS BIGINT) AS e FROM ("
            f"SELECT n, ms, i, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS pos FROM ("
            f"SELECT n, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT n, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d))) WHERE {least}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (SELECT n, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM m GROUP BY n)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""


ORACLE = _oracle()
