"""Archives are the same files whatever the number of partitions, and no shard holds too much."""

import random

import pytest

from homeledger.llm import warc


@pytest.fixture()
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def pages(spark):
    rng = random.Random(3)
    html = lambda: "".join(rng.choice("abcdefgh <>") for _ in range(rng.randrange(400)))
    near, far = [(i, "u", html()) for i in range(300)], [(10**17 + i * 10**9, "u", html()) for i in range(60)]
    same, none = [(77, f"v{i}", html()) for i in range(200)], [(None, f"n{i}", html()) for i in range(150)]
    edge = [(-(1 << 63), "low", html()), ((1 << 63) - 1, "high", html()), (5, None, None)]
    return spark.createDataFrame(near + far + same + none + edge, "page_id long, url string, html string")


def test_same_files_under_any_partitions(spark, partitions):
    table, seen = pages(spark), []
    for n in (2, 4, 7):
        partitions(n)
        made = warc.write_warc(table.repartition(n), file_bytes=3000, least_shard=20_000, most_shard=20_000)
        seen.append(sorted(map(tuple, made.drop("root").collect()), key=repr))
        assert warc.read_warc(made).count() == table.count()
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 20
    records = {}
    for low, way, _, _, n, *_ in seen[0]:
        records[low, way] = records.get((low, way), 0) + n
    assert max(records.values()) <= 4 * 20_000 / warc.RECORD_BYTES
    assert len({way for low, way in records if low == 77}) > 1 and len({way for low, way in records if low is None}) > 1


def test_sorted_within_a_shard(spark):
    made = warc.write_warc(pages(spark), file_bytes=3000, least_shard=20_000, most_shard=20_000)
    ids = {}
    for low, no, rows in ((r.low, r.no, warc.read_warc(made.where(made.file == r.file)).collect()) for r in made.where("way = 0 AND low >= 0").orderBy("low", "no").limit(6).collect()):
        ids.setdefault(low, []).extend(x.page_id for x in rows)
    assert all(x == sorted(x) for x in ids.values())
