"""Query text to concepts, relations, change types and dates, as Column expressions.

A table of queries parses in one projection; the clock is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of the query language.
CONCEPTS = {
    "built structures": ["building", "buildings", "structure", "structures", "house", "houses", "urban", "settlement", "compound", "facility", "facilities", "warehouse", "construction site", "built"],
    "water": ["water", "river", "rivers", "lake", "lakes", "reservoir", "sea", "coast", "coastline", "shoreline", "pond", "canal", "flood", "flooding", "inundation", "wetland"],
    "vegetation": ["vegetation", "forest", "forests", "trees", "tree", "crop", "crops", "cropland", "farmland", "agriculture", "agricultural", "field", "fields", "grass", "green"],
    "road": ["road", "roads", "highway", "street", "track", "tracks", "runway", "airstrip", "railway", "rail"],
    "bare soil": ["bare", "soil", "sand", "desert", "cleared land", "earthworks", "quarry", "mine", "mining", "excavation"],
    "snow": ["snow", "ice", "glacier", "glaciers"],
    "cloud": ["cloud", "clouds", "cloudy"],
    "vessel": ["ship", "ships", "vessel", "vessels", "boat", "boats", "port", "harbor", "harbour"],
    "aircraft": ["airport", "aircraft", "airfield", "plane", "planes", "apron", "hangar"],
}
CHANGE_WORDS = {
    "construction": ["new", "newly", "built", "construction", "constructed", "under construction", "developed", "development", "erected"],
    "clearance": ["cleared", "clearing", "clearance", "deforestation", "deforested", "logging", "felled", "razed"],
    "water_extent_change": ["flood", "flooded", "flooding", "drought", "dried", "receding", "inundated", "water level"],
    "road_development": ["new road", "new roads", "paved", "road building", "road construction"],
    "appearance": ["appeared", "appearance", "emerged", "new"],
    "disappearance": ["disappeared", "removed", "demolished", "destroyed", "vanished", "missing"],
    "expansion": ["expanded", "expansion", "expanding", "grew", "growth", "enlarged", "sprawl"],
    "contraction": ["shrunk", "shrinking", "contraction", "reduced", "retreat", "retreating"],
}
SPECIFIC_FIRST = ["road_development", "construction", "clearance", "water_extent_change", "expansion", "contraction", "disappearance", "appearance"]
TEMPORAL_WORDS = ["new", "newly", "recent", "recently", "since", "before", "after", "during", "changed", "change", "changes", "emerging", "over time", "between", "last", "earliest", "first"]
RELATIONS = ["near", "next to", "along", "beside", "adjacent to", "around", "close to", "within", "inside"]
WEAK_RELATIONS = ["on", "by"]
NOT_ACTIVITIES = ["building", "during"]
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
YEAR = r"(?:19[89][0-9]|20[0-9][0-9])"


def any_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _first_relation(t: Column, names: list[str]) -> Column:
    """``struct<at, order, name>`` of the earliest relation after the text's begin (1-based; ties: the first listed)."""
    found = [F.when(F.regexp_instr(t, F.lit(rf"\b{n}\b")) > 1, F.struct(F.regexp_instr(t, F.lit(rf"\b{n}\b")).alias("at"), F.lit(k).alias("order"), F.lit(n).alias("name"))) for k, n in enumerate(names)]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _present(pairs: list[tuple[Column, Column]]) -> Column:
    """Values whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, v) for c, v in pairs]), lambda x: x.isNotNull())


def _year_start(year: Column) -> Column:
    return F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def parse_queries(queries: DataFrame, now: Column | None = None, text_col: str = "text") -> DataFrame:
    """``queries`` with ``objects, context, spatial_relation, change_types, activities, date_from, date_to, temporal_intent, change_intent, semantic_concepts, embedding_text``."""
    now = F.current_timestamp() if now is None else now
    names = queries.columns
    out = queries.withColumn("_t", squeezed(F.coalesce(F.col(text_col), F.lit(""))))
    t = F.col("_t")
    out = out.withColumn("_relation", F.coalesce(_first_relation(t, RELATIONS), _first_relation(t, WEAK_RELATIONS)))
    at = F.coalesce(F.col("_relation.at"), F.length(t) + 1)
    out = out.withColumns({"_focus": F.substring(t, F.lit(1), at - 1), "_rest": F.substring(t, at, F.length(t))})
    focus, rest = F.col("_focus"), F.col("_rest")
    in_focus = {c: focus.rlike(any_word(w)) for c, w in CONCEPTS.items()}
    # a concept of the context goes by the first listed of its words that is there
    named = {c: reduce(lambda acc, w: F.when(rest.rlike(rf"\b{w}\b"), F.lit(w)).otherwise(acc), reversed(words), F.lit(None).cast("string")) for c, words in CONCEPTS.items()}
    out = out.withColumns({
        "objects": _present([(in_focus[c], F.lit(c)) for c in CONCEPTS]),
        "context": _present([(~in_focus[c] & named[c].isNotNull(), named[c]) for c in CONCEPTS]),
    })
    said = {k: t.rlike(any_word(w)) for k, w in CHANGE_WORDS.items()}
    said["road_development"] = said["road_development"] | (said["construction"] & F.array_contains("objects", "road"))
    years = F.transform(F.regexp_extract_all(t, F.lit(rf"\b({YEAR})\b"), F.lit(1)), lambda y: y.cast("int"))
    year_after = lambda words: F.regexp_extract(t, rf"\b(?:{words})\s+({YEAR})\b", 1).try_cast("int")
    between = t.rlike(r"\bbetween\b") & (F.size(years) >= 2)
    count, unit = F.regexp_extract(t, r"\blast\s+(\d+)?\s*(day|week|month|year)s?\b", 1), F.regexp_extract(t, r"\blast\s+(\d+)?\s*(day|week|month|year)s?\b", 2)
    per_unit = reduce(lambda acc, kv: F.when(unit == kv[0], F.lit(kv[1])).otherwise(acc), UNIT_DAYS.items(), F.lit(None).cast("int"))
    recent = F.when(unit != "", now - F.make_dt_interval(per_unit * F.coalesce(count.try_cast("int"), F.lit(1))))
    last_minute = F.make_timestamp(F.array_max(years), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(0))
    out = out.withColumns({
        "change_types": _present([(said[k], F.lit(k)) for k in SPECIFIC_FIRST]),
        "activities": F.filter(F.regexp_extract_all(t, F.lit(r"\b(\w+ing)\b"), F.lit(1)), lambda w: ~w.isin(NOT_ACTIVITIES)),
        "spatial_relation": F.when(F.size("context") > 0, F.col("_relation.name")),
        "date_from": F.coalesce(recent, F.when(between, _year_start(F.array_min(years))), _year_start(year_after("since|after|from"))),
        "date_to": F.coalesce(F.when(between, last_minute), _year_start(year_after("before|until|to"))),
    })
    types = F.col("change_types")
    generic = F.array_contains(types, "appearance") | F.array_contains(types, "construction")
    specific = F.slice(F.filter(types, lambda x: x != "appearance"), 1, 2)
    intent = F.array_join(F.concat(F.when(generic, F.array(F.lit("appearance"))).otherwise(F.array().cast("array<string>")), specific), "/")
    out = out.withColumns({
        "temporal_intent": (F.size(types) > 0) | t.rlike(any_word(TEMPORAL_WORDS)) | F.col("date_from").isNotNull() | F.col("date_to").isNotNull(),
        "change_intent": F.when(F.size(types) > 0, intent),
        "semantic_concepts": F.when(F.size("objects") > 0, F.col("objects")).when(F.trim(focus) != "", F.array(F.trim(focus))).otherwise(F.array().cast("array<string>")),
    })
    said_context = F.when(F.size("context") > 0, F.concat_ws(" ", F.col("_relation.name"), F.array_join("context", " ")))
    text = F.concat_ws(" ", F.array_join("semantic_concepts", " "), said_context)
    out = out.withColumn("embedding_text", F.coalesce(F.nullif(F.trim(text), F.lit("")), t))
    return out.select(*names, "semantic_concepts", "objects", "activities", "context", "spatial_relation", "change_intent", "change_types", "temporal_intent", "date_from", "date_to", "embedding_text")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def scene_id(checksum: Column) -> Column:
    return F.concat(F.lit("scn_"), F.substring(checksum, 1, 20))


def tile_id(scene: Column, gx: Column, gy: Column) -> Column:
    return F.concat_ws("_", scene, gx.cast("string"), gy.cast("string"))


#: The longest texts kept: of an error of a scene or job, and of a tag. Fixed values.
LONGEST_ERROR, LONGEST_TAG, LONGEST_JOB_ERROR = 1000, 256, 4000


def shortened(text: Column, longest: int = LONGEST_ERROR) -> Column:
    return F.substring(text, 1, longest)


def routed(text: Column, groups: dict[str, list[str]], names: dict[str, list[str]] | None = None) -> Column:
    """The group that a text is one of the ``names`` of, or else the first with a keyword in it; null if none, or without text."""
    asked = F.lower(F.trim(text))
    whole = [asked.isin([n.lower() for n in words]) for words in (names or {}).values()]
    part = [F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: asked.contains(w)), True) for words in groups.values()]
    found = [F.when(hit, F.lit(name)) for name, hit in zip([*(names or {}), *groups], whole + part, strict=True)]
    return F.when(asked != "", F.coalesce(*found))
