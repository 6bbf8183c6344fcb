"""Analyses of listings: the deterministic stand-in, external providers, and validation of their JSON."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.nulls import IMAGE_CATEGORIES, LAYOUT_LABELS, RISK_LEVELS
from ..sources.ship import ship

#: Words that tell of stove heating and of wooden houses.
STOVE_WORDS, WOOD_WORDS = ("krāsns", "stove"), ("koka", "wooden")


def mentions(text: str | Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def stand_in(listings: DataFrame, text: str = "description", rooms: str = "declared_rooms") -> DataFrame:
    """What can be said without a model, as plain columns: rooms as declared, risks by words."""
    rows = listings.withColumn("stove_risk", mentions(text, STOVE_WORDS)).withColumn("wooden_risk", mentions(text, WOOD_WORDS))
    rows = rows.withColumn("effective_rooms", F.when(F.col(rooms) > 0, F.col(rooms)))
    risk = F.when(F.col("stove_risk") | F.col("wooden_risk"), "High").otherwise("Unknown")
    return rows.withColumn("risk_level", risk).withColumn("layout_class", F.lit("mock_from_ss_rooms")).withColumn("confidence", F.lit("Unclear"))


def provided(listings: DataFrame, provider: Callable[[dict], str], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """listings with an external provider's answer: (raw, error); failures are rows, never exceptions.

    A row may hold images (as bytes); the provider gets it whole. Failed attempts are repeated after pause, twice pause, ...
    """
    ship(listings.sparkSession)
    names = listings.columns
    schema = StructType([*listings.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b[names].to_dict("records"):
                raw, error = None, None
                for n in range(attempts):
                    time.sleep(pause * n)
                    try:
                        raw, error = provider(row), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider's failure is this row's result
                        error = str(e)
                out.append((raw, error))
            yield b.assign(raw=[x for x, _ in out], error=[y for _, y in out])

    return listings.mapInPandas(run, schema)


#: The fields of an answer by kind. A kind tells what is allowed and how a value is read.
IMAGE_FIELDS = {"image_id": "required", "category": "enum", "useful_for_layout": "flag", "useful_for_building_type": "flag", "duplicate_of_image_id": "text", "likely_room_group": "text", "explanation": "text"}
PASS1_FIELDS = {"floor_plan_image_ids": "texts", "images_used_for_layout": "texts", "images_used_for_building_type": "texts", "ignored_images": "texts", "duplicate_images": "texts"}
PASS2_FIELDS = {
    "ai_detected_living_rooms": "whole", "effective_private_rooms": "whole", "walkthrough_rooms": "whole", "kitchen_living_detected": "flag", "separate_kitchen_detected": "flag", "layout_class": "text",
    "layout_confidence_label": "enum", "ss_vs_ai_room_conflict": "flag", "layout_explanation_user": "required", "floor_plan_image_ids": "texts", "building_type_guess": "text", "series_guess": "text",
    "wooden_building_risk": "flag", "stove_heating_risk": "flag", "mortgage_risk_level": "enum", "mortgage_risk_reasons": "texts", "mortgage_explanation_user": "required",
}
DOMAINS = {"category": IMAGE_CATEGORIES, "layout_confidence_label": LAYOUT_LABELS, "mortgage_risk_level": RISK_LEVELS}


def _kind(v: Column) -> Column:
    """Type of a variant: null where it is missing, VOID for a JSON null."""
    return F.schema_of_variant(v)


def _member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _texts(v: Column) -> tuple[Column, Column]:
    """(trimmed texts without blank ones, error) of a list of texts; null and missing are empty."""
    kind, items = _kind(v), F.try_variant_get(v, "$", "array<string>")
    none = kind.isNull() | (kind == "VOID")
    empty = F.array().cast("array<string>")
    fits = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(none, empty).when(fits, kept).otherwise(empty), F.when(~none & ~F.coalesce(fits, F.lit(False)), "list of texts expected")


def _field(whole: Column, key: str, kind: str) -> tuple[Column, Column]:
    """(value, error) of one field of an object."""
    v = _member(whole, key)
    given, none = _kind(v), _kind(v).isNull() | (_kind(v) == "VOID")
    said = F.trim(F.try_variant_get(v, "$", "string"))
    if kind == "whole":
        return F.when(given == "BIGINT", F.try_variant_get(v, "$", "bigint")), F.when(~none & (given != "BIGINT"), "whole number expected")
    if kind == "flag":  # as truth in JSON's own terms: null, false, zero and what is empty are not
        number = F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)) != 0
        full = F.when(given == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(given == "STRING", F.try_variant_get(v, "$", "string") != "").when(given.startswith("ARRAY"), F.to_json(v) != "[]").when(given.startswith("OBJECT"), F.to_json(v) != "{}")
        return F.when(none, F.lit(False)).otherwise(F.coalesce(full, number)), F.lit(None).cast("string")
    if kind == "texts":
        return _texts(v)
    if kind == "text":
        return F.when(given == "STRING", F.nullif(said, F.lit(""))), F.when(~none & (given != "STRING"), "text expected")
    if kind == "required":
        fits = F.coalesce((given == "STRING") & (said != ""), F.lit(False))
        return F.when(fits, said), F.when(~fits, "text missing")
    plain = F.try_variant_get(v, "$", "string")
    fits = F.coalesce((given == "STRING") & plain.isin(*DOMAINS[key]), F.lit(False))
    return F.when(fits, plain), F.when(~fits, "not in its domain")


def _said(key: str, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit(f"{key}: "), error))


def _object(raw: str) -> Column:
    """The answer as a variant if it is a JSON object, else null."""
    v = F.try_parse_json(raw)
    return F.when(F.startswith(_kind(v), F.lit("OBJECT")), v)


def _room_groups(v: Column) -> tuple[Column, Column]:
    """(map of room -> image ids, error) of an object, or of a list of {room, image_ids}; a later room of a name wins."""
    kind = _kind(v)
    none = kind.isNull()
    pairs = F.when(F.startswith(kind, F.lit("OBJECT")), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
    listed = F.try_variant_get(v, "$", "array<variant>")
    room = lambda x: F.when(_kind(_member(x, "room")) == "STRING", F.nullif(F.trim(F.try_variant_get(x, "$.room", "string")), F.lit("")))
    pairs = F.coalesce(pairs, F.transform(listed, lambda x: F.struct(room(x).alias("key"), _member(x, "image_ids").alias("value"))))
    bad_item = F.coalesce(F.exists(listed, lambda x: ~F.startswith(_kind(x), F.lit("OBJECT"))), F.lit(False))
    bad_room = F.coalesce(F.exists(pairs, lambda p: p["key"].isNull()), F.lit(False))
    bad_ids = F.coalesce(F.exists(pairs, lambda p: _texts(p["value"])[1].isNotNull()), F.lit(False))
    error = F.when(none, None).when(~(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))), "object or list expected").when(bad_item, "objects expected").when(bad_room, "room missing").when(bad_ids, "list of texts expected")
    kept = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), _texts(p["value"])[0].alias("value")))
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.when(error.isNull() & ~none, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,array<string>>")), error


def validated_pass1(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds images, the lists of image ids, room groups, and errors: what is wrong with a first answer, as an array."""
    rows = df.withColumn("_v", _object(raw))
    v = F.col("_v")
    listed = F.try_variant_get(v, "$.images", "array<variant>")
    kind = _kind(_member(v, "images"))
    is_list = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    objects = ~F.coalesce(F.exists(listed, lambda x: ~F.coalesce(F.startswith(_kind(x), F.lit("OBJECT")), F.lit(False))), F.lit(False))
    image = lambda x: F.struct(*(_field(x, k, t)[0].alias(k) for k, t in IMAGE_FIELDS.items()))
    wrong = lambda x: F.array_compact(F.array(*(_said(f"images.{k}", _field(x, k, t)[1]) for k, t in IMAGE_FIELDS.items())))
    images = F.when(is_list & objects, F.transform(listed, image))
    of_images = F.when(~is_list, F.array(F.lit("images: list missing"))).when(~objects, F.array(F.lit("images: objects expected"))).otherwise(F.array_distinct(F.flatten(F.transform(listed, wrong))))
    fields = {k: _field(v, k, t) for k, t in PASS1_FIELDS.items()}
    groups, bad_groups = _room_groups(_member(v, "image_groups_by_room"))
    rest = F.array_compact(F.array(*(_said(k, e) for k, (_, e) in fields.items()), _said("image_groups_by_room", bad_groups)))
    errors = F.when(v.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(of_images, rest))
    return rows.select(*df.columns, images.alias("images"), *(x.alias(k) for k, (x, _) in fields.items()), groups.alias("image_groups_by_room"), errors.alias("errors"))


def validated_pass2(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the 17 fields of a second answer and errors, as an array; values that do not fit are null."""
    rows = df.withColumn("_v", _object(raw))
    fields = {k: _field(F.col("_v"), k, t) for k, t in PASS2_FIELDS.items()}
    errors = F.when(F.col("_v").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*(_said(k, e) for k, (_, e) in fields.items()))))
    return rows.select(*df.columns, *(x.alias(k) for k, (x, _) in fields.items()), errors.alias("errors"))


def response_schema(number: int) -> dict:
    """What a provider is asked to answer with: a schema document for the first or the second pass, from the fields' kinds."""
    texts = {"type": "ARRAY", "items": {"type": "STRING"}}
    made = {"whole": {"type": "INTEGER", "nullable": True}, "flag": {"type": "BOOLEAN"}, "text": {"type": "STRING", "nullable": True}, "required": {"type": "STRING"}, "texts": texts}
    of = lambda k, t: {"type": "STRING", "enum": list(DOMAINS[k])} if t == "enum" else made[t]
    needed = lambda fields: [k for k, t in fields.items() if t in ("required", "enum")]
    whole = lambda fields, more: {"type": "OBJECT", "properties": {k: of(k, t) for k, t in fields.items()} | more, "required": needed(fields) + [k for k in more if k == "images"]}
    if number == 2:
        return whole(PASS2_FIELDS, {})
    groups = {"type": "ARRAY", "items": {"type": "OBJECT", "properties": {"room": {"type": "STRING"}, "image_ids": texts}, "required": ["room", "image_ids"]}}
    return whole(PASS1_FIELDS, {"images": {"type": "ARRAY", "items": whole(IMAGE_FIELDS, {})}, "image_groups_by_room": groups})


def prompt(heading: str, rules: tuple[str, ...], fields: tuple[str, ...], **parts: Column) -> Column:
    """A request as text: a heading, rules, the fields asked for, and the input as one JSON object."""
    lines = [heading, *rules, "Return only valid JSON with the fields: " + ", ".join(fields) + ".", "Input:"]
    return F.concat_ws("\n", *map(F.lit, lines), F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())), {"ignoreNullFields": "false"}))


def pass1_prompt(images: str = "images") -> Column:
    """Asks to classify every image (array<struct<image_id, source_url>>) of a listing."""
    rules = ("Classify every image.", "Categories: " + ", ".join(IMAGE_CATEGORIES) + ".", "The attached images follow the order of the list.")
    return prompt("Classify the images of an apartment listing.", rules, ("images", *PASS1_FIELDS, "image_groups_by_room"), images=F.col(images))


def pass2_prompt(text: str = "description", fields: str = "fields", first: str = "pass1", priors: str = "priors") -> Column:
    """Asks for layout and mortgage suitability, given the text, the declared fields, the first answer and layout priors."""
    rules = (
        "Declared room counts are claims, not facts.", "A kitchen-living room is not a private room, nor is a walkthrough room.", "A floor plan is the first source for the layout.",
        "layout_confidence_label: " + ", ".join(LAYOUT_LABELS) + ".", "mortgage_risk_level: " + ", ".join(RISK_LEVELS) + ".", "Explanations in English.",
    )
    return prompt("Judge layout and mortgage suitability of an apartment listing.", rules, tuple(PASS2_FIELDS), listing_text=F.col(text), declared=F.col(fields), pass1=F.col(first), layout_priors=F.col(priors))


def images_by_room(df: DataFrame, images: str = "images") -> DataFrame:
    """(listing_id, rooms): room group -> its image ids in order."""
    rows = df.select("listing_id", F.posexplode(images).alias("pos", "x")).where("x.likely_room_group IS NOT NULL")
    rows = rows.groupBy("listing_id", F.col("x.likely_room_group").alias("room")).agg(F.array_sort(F.collect_list(F.struct("pos", "x.image_id"))).alias("ids"))
    return rows.groupBy("listing_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", F.col("ids.image_id").alias("ids"))))).alias("rooms"))


def positive_ids(c: str) -> Column:
    """Positive whole numbers of a JSON list, each once, in order; other items are skipped."""
    items = F.transform(F.from_json(c, "array<string>"), lambda x: x.try_cast("bigint"))
    return F.array_distinct(F.filter(items, lambda x: x > 0))
