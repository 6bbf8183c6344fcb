"""Answers of providers against a plain reading of the same rules; requests and schemas; sources with injected clients."""

import hashlib
import json
import random

import pandas as pd
import pytest

from homeledger.functions import text
from homeledger.functions.nulls import IMAGE_CATEGORIES
from homeledger.operators import analysis, pages, places
from homeledger.sources import stores

VALUES = (None, True, False, 0, 3, -1, 2.5, "", "  ", " Likely ", "Likely", "Low", "kitchen", "x", [], ["a", " b ", ""], ["a", 1], ["a", None], {}, {"k": 1}, "Conflict")


def texts(v):
    if v is None:
        return [], False
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        return [], True
    return [x.strip() for x in v if x.strip()], False


def field(data, key, kind):
    """(value, wrong) by the plain rules."""
    v = data.get(key)
    if kind == "whole":
        ok = isinstance(v, int) and not isinstance(v, bool)
        return (v if ok else None), v is not None and not ok
    if kind == "flag":
        return bool(v), False
    if kind == "texts":
        return texts(v)
    if kind == "text":
        return (v.strip() or None if isinstance(v, str) else None), v is not None and not isinstance(v, str)
    if kind == "required":
        ok = isinstance(v, str) and v.strip() != ""
        return (v.strip() if ok else None), not ok
    ok = isinstance(v, str) and v in analysis.DOMAINS[key]
    return (v if ok else None), not ok


def made(rng, fields):
    out = {}
    for k, kind in fields.items():
        if rng.random() < 0.25:
            fit = {"whole": 2, "flag": True, "texts": ["t"], "text": "t", "required": "t", "enum": (analysis.DOMAINS.get(k) or ("",))[0]}[kind]
            out[k] = rng.choice((*VALUES, fit))
        elif rng.random() < 0.8:
            out[k] = {"whole": rng.randrange(5), "flag": rng.random() < 0.5, "texts": [" a", "b "], "text": " t ", "required": " said ", "enum": rng.choice(analysis.DOMAINS.get(k) or ("",))}[kind]
    return out


def test_second_answers(spark):
    rng = random.Random(5)
    rows = [(i, json.dumps(made(rng, analysis.PASS2_FIELDS))) for i in range(250)] + [(900, "[1]"), (901, "null"), (902, "{}"), (903, "no"), (904, None)]
    got = {r.listing_id: r for r in analysis.validated_pass2(spark.createDataFrame(rows, "listing_id long, raw string")).collect()}
    for i, raw in rows[:250] + [(902, "{}")]:
        want = {k: field(json.loads(raw), k, t) for k, t in analysis.PASS2_FIELDS.items()}
        assert [e.split(":")[0] for e in got[i].errors] == [k for k, (_, wrong) in want.items() if wrong], raw
        assert {k: got[i][k] for k in want} == {k: v for k, (v, _) in want.items()}, raw
    assert all(got[i].errors == ["not an object"] for i in (900, 901, 903, 904))
    assert sum(not r.errors for r in got.values()) > 3 and len(got[902].errors) == 4


def groups(v):
    if isinstance(v, list):
        out = {}
        for x in v:
            if not isinstance(x, dict) or not isinstance(x.get("room"), str) or not x["room"].strip() or texts(x.get("image_ids"))[1]:
                return {}, True
            out[x["room"].strip()] = texts(x.get("image_ids"))[0]
        return out, False
    if not isinstance(v, dict):
        return {}, True
    return {k: texts(x)[0] for k, x in v.items()}, any(texts(x)[1] for x in v.values())


def test_first_answers(spark):
    rng = random.Random(6)
    rooms = ({}, {"a": ["1", " 2 "], "b": None}, {"a": [1]}, [], [{"room": " a ", "image_ids": ["1"]}, {"room": "a", "image_ids": ["2"]}], [{"room": ""}], [3], "x", None, 5)
    rows = []
    for i in range(150):
        data = made(rng, analysis.PASS1_FIELDS)
        data["images"] = rng.choice(([made(rng, analysis.IMAGE_FIELDS) for _ in range(rng.randrange(4))], [made(rng, analysis.IMAGE_FIELDS)], [{"image_id": "1", "category": rng.choice(IMAGE_CATEGORIES)}], *([[3], "x", None] if i % 5 == 0 else [])))
        if rng.random() < 0.7:
            data["image_groups_by_room"] = rng.choice(rooms)
        rows.append((i, json.dumps(data)))
    got = {r.listing_id: r for r in analysis.validated_pass1(spark.createDataFrame(rows, "listing_id long, raw string")).collect()}
    for i, raw in rows:
        data, r = json.loads(raw), got[i]
        of = {e.split(":")[0] for e in r.errors}
        images = data["images"]
        if not isinstance(images, list) or not all(isinstance(x, dict) for x in images):
            assert "images" in of and r.images is None
        else:
            want = [{k: field(x, k, t) for k, t in analysis.IMAGE_FIELDS.items()} for x in images]
            assert {e.removeprefix("images.") for e in of if e.startswith("images.")} == {k for x in want for k, (_, wrong) in x.items() if wrong}, raw
            assert [x.asDict() for x in r.images] == [{k: v for k, (v, _) in x.items()} for x in want]
        for k, t in analysis.PASS1_FIELDS.items():
            assert (r[k], k in of) == field(data, k, t), raw
        want, wrong = groups(data.get("image_groups_by_room", {}))
        assert ("image_groups_by_room" in of) == wrong and (wrong or r.image_groups_by_room == want), raw


def test_requests(spark):
    first, second = analysis.response_schema(1), analysis.response_schema(2)
    assert set(second["properties"]) == set(analysis.PASS2_FIELDS) and second["required"] == ["layout_confidence_label", "layout_explanation_user", "mortgage_risk_level", "mortgage_explanation_user"]
    assert first["properties"]["images"]["items"]["required"] == ["image_id", "category"] and first["required"] == ["images"] and json.dumps(first)
    df = spark.createDataFrame([("Flöt", {"Iela": "A"}, "{}", ["602"], [("1", "u")])], "description string, fields map<string,string>, pass1 string, priors array<string>, images array<struct<image_id:string,source_url:string>>")
    row = df.select(analysis.pass1_prompt().alias("a"), analysis.pass2_prompt().alias("b")).first()
    assert json.loads(row.a.split("Input:\n")[1]) == {"images": [{"image_id": "1", "source_url": "u"}]}
    assert json.loads(row.b.split("Input:\n")[1]) == {"listing_text": "Flöt", "declared": {"Iela": "A"}, "pass1": "{}", "layout_priors": ["602"]}
    assert all(k in row.b for k in analysis.PASS2_FIELDS)


def test_provider_is_asked_again(spark, tmp_path):
    def provider(row):
        mark = tmp_path / str(row["listing_id"])
        mark.write_text((mark.read_text() if mark.exists() else "") + "x")
        if row["listing_id"] == 1 and len(mark.read_text()) < 3 or row["listing_id"] == 2:
            raise RuntimeError("busy")
        return json.dumps({"n": len(row["image"] or b"")})

    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, None)], "listing_id long, image binary").coalesce(1)
    got = {r.listing_id: (r.raw, r.error) for r in analysis.provided(df, provider).collect()}
    assert got == {1: ('{"n": 3}', None), 2: (None, "busy"), 3: ('{"n": 0}', None)}
    assert (tmp_path / "1").read_text() == "xxx" and (tmp_path / "2").read_text() == "xxx"


def test_files_are_named_by_address_and_content(spark):
    def get(url):
        if "gone" in url:
            raise OSError("gone")
        return url.encode()

    df = spark.createDataFrame([("http://h/a.JPG?x=1",), ("http://h/gone.png",), ("http://h/b",)], "url string")
    got = {r.url: r for r in stores.fetched_files(df, stores.Client(get, attempts=1)).collect()}
    body = b"http://h/a.JPG?x=1"
    assert got["http://h/a.JPG?x=1"].digest == hashlib.sha256(body).hexdigest() and bytes(got["http://h/a.JPG?x=1"].content) == body
    assert got["http://h/a.JPG?x=1"].file.endswith(".jpg") and got["http://h/gone.png"].file is None and got["http://h/gone.png"].error == "gone"
    assert got["http://h/b"].file == f"{hashlib.sha256(b'http://h/b').hexdigest()[:16]}-{hashlib.sha256(b'http://h/b').hexdigest()[:16]}.jpg"


def test_details_stay_beside_their_summaries(spark):
    page = '<div id="msg_div_msg">a<b>b</b>c</div>'
    client = stores.text_client(lambda u: (page.encode("utf-16"), "text/html; charset=UTF-16") if u == "u1" else 1 / 0, attempts=1)
    df = spark.createDataFrame([("u1", "one"), ("u2", "two")], "url string, title string")
    got = {r.title: r for r in stores.with_details(df, client, pages.parse_detail_pages).collect()}
    assert got["one"].detail_description == "a\nb\nc" and got["one"].detail_error is None
    assert got["two"].detail_description is None and "division" in got["two"].detail_error


def test_geocoder_and_points(spark):
    def geocoder(q):
        return "[]" if q == "nowhere" else json.dumps([{"lat": "56.9", "lon": "24.1", "display_name": q}, {"lat": "1", "lon": "1"}])

    df = spark.createDataFrame([(1, "Riga"), (2, "nowhere")], "listing_id long, query string")
    got = {r.listing_id: (r.lat, r.lon, r.found) for r in stores.located(df, geocoder).collect()}
    assert got == {1: (56.9, 24.1, True), 2: (None, None, False)}
    at = spark.createDataFrame([(1, 56.9, 24.1)], "listing_id long, lat double, lon double")
    answer = stores.pois_near(at, lambda q: json.dumps({"elements": [{"type": "node", "id": 5, "lat": 56.9, "lon": 24.1, "tags": {"shop": "supermarket", "name": q}}]}))
    (r,) = places.poi_rows(answer).collect()
    assert (r.element_id, r.category, r.name) == (5, "grocery_shop", "around:1800,56.900000,24.100000")


def test_markers_and_console(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.5, "Rīga")], "listing_id long, lat double, title string")
    assert json.loads(stores.marker_text(df)) == [{"listing_id": 1, "lat": 2.0, "title": None}, {"listing_id": 2, "lat": 3.5, "title": "Rīga"}] and "Rīga" in stores.marker_text(df)
    ranked = spark.createDataFrame([(2, None, "b"), (1, 81.25, "a"), (3, 1.0, "c")], "position int, score double, title string")
    assert stores.console_lines(ranked, 2) == ["  1.    81.2  a", "  2. unknown  b"]


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{\n"a": 1}')
    (tmp_path / "j" / "2.json").write_text("no json")
    got = {r.path.rsplit("/", 1)[1]: r.raw for r in stores.json_documents(spark, str(tmp_path / "j")).collect()}
    assert got == {"1.json": '{\n"a": 1}', "2.json": None}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.png").write_bytes(b"png")
    (r,) = stores.binary_files(spark, str(tmp_path / "p")).collect()
    assert r.digest == hashlib.sha256(b"png").hexdigest() and r.uri == "data:image/png;base64,cG5n"
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(stores.backup(spark, str(tmp_path / "t"), pd.Timestamp(2024, 1, 2, 3, 4, 5))).count() == 3
    (tmp_path / ".env").write_text("# c\nHOME_A='env file'\nHOME_B=two\nHOME_C=three\n")
    with pytest.MonkeyPatch.context() as m:
        m.setenv("HOME_B", "environment")
        assert stores.settings({"c": "given", "a": None}, str(tmp_path / ".env"), {"d": 4}) == {"a": "env file", "b": "environment", "c": "given", "d": 4}


def test_translations_and_rounding(spark):
    table = {"en": {"unknown": "unknown", "price": "Price"}, "ru": {"price": "Цена"}}
    df = spark.createDataFrame([("price", 0.125), ("Price", 2.5), ("unknown", 3.5), ("other", None)], "t string, v double")
    got = df.select(text.translated("t", "ru", table, {"Price": "price"}).alias("t"), text.exact_round("v", 2).alias("a"), text.exact_round("v").alias("b")).collect()
    assert [tuple(r) for r in got] == [("Цена", 0.12, 0.0), ("Цена", 2.5, 2.0), ("unknown", 3.5, 4.0), ("other", None, None)]


def test_links_of_all_pages(spark, sf):
    """Titles and links against a plain reading of the pages' markup."""
    import html
    import re
    from urllib.parse import urljoin

    from homeledger.plans import queries as core

    got = {r.page_id: r for r in core.queries()["page_links"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = [html.unescape(a or b) for a, b in re.findall(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", r.html or ""))]
        assert got[r.page_id].links == list(dict.fromkeys(urljoin(r.url, x) for x in found if x))


def test_bootstrap(spark, tmp_path):
    from homeledger.sources import catalog

    at = str(tmp_path / "db")
    assert set(catalog.bootstrap(spark, at)) == set(catalog.TABLES)
    assert catalog.stored(spark, at, "profiles").where("is_builtin").count() == 9 and catalog.stored(spark, at, "layout_priors").count() == 8
    assert catalog.stored(spark, at, "listings").count() == 0 and catalog.bootstrap(spark, at) == []
