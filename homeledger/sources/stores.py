"""Connectors: paged crawls, fetches by an injected client, stored tables, snapshots and exports."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .ship import ship

#: Pages that a crawl may reach at most, rows of a full page.
MOST_PAGES, FULL_PAGE = 500, 30


@dataclass
class Client:
    """Fetches text by address: a function, least seconds between calls, attempts. Failures come back as rows."""

    get: Callable[[str], str]
    pause: float = 0.0
    attempts: int = 3
    last: float = field(default=0.0, compare=False)

    def fetch(self, url: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(self.attempts):
            time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
            self.last = time.monotonic()
            try:
                return self.get(url), None
            except Exception as e:  # noqa: BLE001  a failed page is this row's result
                error = str(e)
                time.sleep(self.pause * (n + 1))
        return None, error


def decoded(body: bytes, content_type: str | None) -> str:
    """Text of a response: the header's charset, else UTF-8; what cannot be read is replaced."""
    charset = (content_type or "").lower().partition("charset=")[2].split(";")[0].strip() or "utf-8"
    try:
        return body.decode(charset, errors="replace")
    except LookupError:
        return body.decode("utf-8", errors="replace")


def fetched(urls: DataFrame, client: Client, key: str = "url") -> DataFrame:
    """urls with html and error, fetched in parallel by partition; a client paces itself in each task."""
    schema = StructType([*urls.schema.fields, StructField("html", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [client.fetch(u) for u in b[key]]
            yield b.assign(html=[h for h, _ in got], error=[e for _, e in got])

    return urls.mapInPandas(run, schema)


def text_client(open_url: Callable[[str], tuple[bytes, str | None]], **pace) -> Client:
    """A client over what gives (body, content type) of an address: text by the header's charset."""
    return Client(lambda url: decoded(*open_url(url)), **pace)


def fetched_files(urls: DataFrame, client: Client, key: str = "url") -> DataFrame:
    """urls with content (bytes), its SHA-256, a file name that follows from address and content, and error.

    The client's function gives bytes. What failed has nulls and its error; nothing is left on a local disk.
    """
    schema = StructType([*urls.schema.fields, StructField("content", BinaryType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [client.fetch(u) for u in b[key]]
            yield b.assign(content=[x for x, _ in got], error=[e for _, e in got])

    rows = urls.mapInPandas(run, schema)
    path = F.element_at(F.split(F.split(key, "[?#]")[0], "/"), -1)
    suffix = F.when(F.contains(path, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1)))).otherwise(".jpg")
    rows = rows.withColumn("digest", F.when(F.col("content").isNotNull(), F.sha2("content", 256)))
    return rows.withColumn("file", F.concat(F.substring(F.sha2(key, 256), 1, 16), F.lit("-"), F.substring("digest", 1, 16), suffix))


def with_details(summaries: DataFrame, client: Client, parsed: Callable[[DataFrame], DataFrame], key: str = "url") -> DataFrame:
    """Summaries left-joined to their detail pages: a page that failed leaves its summary, with the error in detail_error."""
    pages = fetched(summaries.select(key), client, key)
    details = parsed(pages.where("error IS NULL").select(F.col(key).alias("url"), "html"))
    failed = pages.select(key, F.col("error").alias("detail_error"))
    own = details.select(*(F.col(c).alias(key if c == "url" else f"detail_{c}") for c in details.columns))
    return summaries.join(failed, key, "left").join(own, key, "left")


def located(places: DataFrame, geocoder: Callable[[str], str], query: str = "query", attempts: int = 1) -> DataFrame:
    """places with the first hit of a geocoder's JSON answer: lat, lon, display_name; without a hit they are null and found is false."""
    from ..operators.analysis import provided

    rows = provided(places, _Asked(geocoder, query), attempts)
    hit = F.try_element_at(F.from_json("raw", "array<struct<lat:string,lon:string,display_name:string>>"), F.lit(1))
    lat, lon = hit["lat"].try_cast("double"), hit["lon"].try_cast("double")
    return rows.withColumns({"lat": lat, "lon": lon, "display_name": hit["display_name"], "found": lat.isNotNull() & lon.isNotNull()}).drop("raw")


def pois_near(places: DataFrame, source: Callable[[str], str], radius_m: float = 1800.0, attempts: int = 1) -> DataFrame:
    """Answers of a source of points of interest for places (listing_id, lat, lon): payload (JSON) and error; poi_rows reads them."""
    from ..operators.analysis import provided

    text = F.format_string("around:%.0f,%.6f,%.6f", F.lit(float(radius_m)), "lat", "lon")
    return provided(places.withColumn("query", text), _Asked(source, "query"), attempts).withColumnRenamed("raw", "payload")


@dataclass
class _Asked:
    """A provider that is asked with one column of a row."""

    ask: Callable[[str], str]
    column: str

    def __call__(self, row: dict) -> str:
        return self.ask(row[self.column])


def page_url(base: str, n: int) -> str:
    return base if n <= 1 else base.rstrip("/") + f"/page{n}.html"


CRAWLED = "page int, pos int, ss_id string, url string, title string, district string, street string, price_text string"


def list_pages(urls: DataFrame, client: Client) -> DataFrame:
    """The listings of list pages (page, url), fetched in parallel, with the highest page that each links to (a row of position -1).

    A page that fails has no rows.
    """
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from homeledger.operators.pages import list_rows, navigation

        names = ("ss_id", "url", "title", "district", "street", "price_text")
        for b in batches:
            out = []
            for page, url in zip(b["page"], b["url"], strict=True):
                text, _ = client.fetch(url)
                if text:
                    out.append((page, -1, None, str(navigation(text, url)["max_page"]), None, None, None, None))
                    out += [(page, i, *(r[c] for c in names)) for i, r in enumerate(list_rows(text, url))]
            yield pd.DataFrame(out, columns=["page", "pos", *names])

    return urls.mapInPandas(run, CRAWLED)


def crawl(spark: SparkSession, base: str, client: Client, limit: int | None = None, tasks: int = 8) -> DataFrame:
    """Listings of all pages from a first page on, each once as on its first page.

    The frontier is the driver's, the pages are the executors': the first page tells the highest number, the pages up to it
    are fetched in parallel; while these link to higher ones, or the last of them is full, the next ones are. More
    than MOST_PAGES pages are an error; a page that fails has no rows, nor has one whose listings came before as a whole.
    """
    found, done, most = None, 0, 1
    while done < most:
        if most > MOST_PAGES:
            raise RuntimeError(f"more than {MOST_PAGES} pages")
        urls = spark.createDataFrame([(n, page_url(base, n)) for n in range(done + 1, most + 1)], "page int, url string")
        rows = spark.createDataFrame(list_pages(urls.repartition(min(tasks, most - done)), client).toPandas().astype(object).where(lambda x: x.notna(), None), CRAWLED)  # at most MOST_PAGES pages in all
        links = rows.where("pos < 0").agg(F.max(F.col("url").cast("int"))).first()[0] or most
        listed = rows.where("pos >= 0")
        keys = [tuple(r.ids) for r in listed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "ss_id")))["ss_id"].alias("ids")).where(F.col("page") == most).collect()]
        before = [] if found is None else [tuple(r.ids) for r in found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "ss_id")))["ss_id"].alias("ids")).collect()]
        found, done = listed if found is None else found.unionByName(listed), most
        again = bool(keys) and keys[0] in before
        most = max(most, links) if not again else most
        if most == done and not again and keys and len(keys[0]) >= FULL_PAGE:
            most += 1
    once = first_seen(found).select(*(f.name for f in found.schema))
    return once if limit is None else once.orderBy("page", "pos").limit(limit)


def first_seen(rows: DataFrame, key: str = "ss_id") -> DataFrame:
    """Of rows with (page, pos) the first of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("page", "pos")).alias("x")).select(key, *(f"x.{c}" for c in rest))


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A table whose files appear together at the end of the job."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def backup(spark: SparkSession, path: str, now) -> str:
    """Copies a table to <path>-backup-<time>; returns the copy's path."""
    to = f"{path.rstrip('/')}-backup-{now:%Y%m%d-%H%M%S}"
    spark.read.parquet(path).write.parquet(to)
    return to


def marker_text(markers: DataFrame) -> str:
    """Markers as one JSON array, indented by two, other than ASCII as it is; for a view's bounded number of them."""
    rows = markers.select(F.to_json(F.struct(*markers.columns), {"ignoreNullFields": "false"}).alias("x")).collect()
    return json.dumps([json.loads(r.x) for r in rows], indent=2, ensure_ascii=False)


def console_lines(ranked: DataFrame, n: int = 20) -> list[str]:
    """The first n rows of a ranked view as lines: position, score, title."""
    rows = ranked.where(F.col("position") <= n).orderBy("position").select("position", "score", "title").collect()
    return [f"{r.position:>3}. {'unknown' if r.score is None else format(r.score, '.1f'):>7}  {r.title}" for r in rows]


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept and other than ASCII as it is."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, bytes, uri): files with their SHA-256 and as data: addresses."""
    kind = F.when(F.col("path").rlike("(?i)\\.png$"), "image/png").when(F.col("path").rlike("(?i)\\.webp$"), "image/webp").otherwise("image/jpeg")
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("uri"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): whole JSON files as text; those that are not JSON are null."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.select("path", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("raw"))


def settings(given: dict | None = None, env_file: str | None = None, defaults: dict | None = None, prefix: str = "HOME_") -> dict:
    """Settings by name: what is given, else the environment, else an env file, else defaults."""
    found = dict(defaults or {})
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                found[name.strip().removeprefix(prefix).lower()] = value.strip().strip("'\"")
    found |= {k.removeprefix(prefix).lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    return found | {k: v for k, v in (given or {}).items() if v is not None}
