"""Parameter recipes, presets and names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Options of the operators by terrain (fixed values).
PRESETS = {
    "flat_agricultural": {"svf": {"radius": 20, "directions": 16, "noise": 1}, "openness": {"radius": 15, "directions": 16}, "slrm": {"radius": 20}, "local_dominance": {"least": 10, "most": 20, "height": 1.7}},
    "forested": {"svf": {"radius": 10, "directions": 16, "noise": 3}, "openness": {"radius": 5, "directions": 16}, "slrm": {"radius": 12}, "local_dominance": {"least": 5, "most": 15, "height": 1.5}},
    "upland_steep": {"svf": {"radius": 5, "directions": 16, "noise": 2}, "openness": {"radius": 5, "directions": 16}, "slrm": {"radius": 8}, "local_dominance": {"least": 5, "most": 10, "height": 1.0}},
    "coastal": {"svf": {"radius": 15, "directions": 32, "noise": 1}, "openness": {"radius": 10, "directions": 32}, "slrm": {"radius": 25}, "local_dominance": {"least": 15, "most": 30, "height": 2.0}},
}

#: Parameters that a recipe may give to each algorithm: kind, default, and least and greatest if bounded (fixed values).
DEFINITIONS = {
    "hillshade": {"azimuths": ("string", "315,45,135,225,270,360"), "altitude": ("float", 45.0, 0, 90)},
    "slrm": {"trend_radius": ("int", 20, 1, 500)},
    "svf": {"search_radius": ("int", 10, 1, 200), "num_directions": ("int", 16, 4, 64), "noise_level": ("int", 0, 0, 3)},
    "slope": {"units": ("string", "degrees")},
    "openness": {"search_radius": ("int", 10, 1, 200), "num_directions": ("int", 16, 4, 64)},
    "mstp": {"local_radius": ("int", 5, 1, 100), "meso_radius": ("int", 50, 1, 1000), "broad_radius": ("int", 500, 1, 5000)},
    "local_dominance": {"min_radius": ("int", 5, 1, 100), "max_radius": ("int", 20, 1, 500), "observer_height": ("float", 1.7, 0.1)},
    "asvf": {"search_radius": ("int", 10, 1, 200), "num_directions": ("int", 16, 4, 64), "azimuth": ("float", 315.0, 0, 360), "anisotropy": ("float", 1.0, 0.1)},
    "e4mstp": {},
    "pca": {"num_directions": ("int", 16, 4, 64)},
    "vat": {},
    "red_relief": {},
    "blend": {"mode": ("string", "multiply")},
}


def preset(name: str) -> dict:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return json.loads(json.dumps(PRESETS[name]))


def slug(name: Column) -> Column:
    """A file name: characters other than letters, digits, space, _ - . become _, white space too; 'untitled' if nothing is left."""
    x = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9 _\-.]", "_"))
    x = F.regexp_replace(F.regexp_replace(x, r"^[._/\\]+", ""), r"\s+", "_")
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, "untitled").otherwise(x)


def _kind(value: Column) -> Column:
    """The kind of a variant as Spark names it (OBJECT, STRING, BIGINT, ...); NULL if there is none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


#: Kinds of JSON values that pass as each kind of parameter. A boolean passes as a number, as in the compatible variant.
WHOLE, BROKEN = ("BIGINT", "INT", "SMALLINT", "TINYINT"), ("DECIMAL", "DOUBLE", "FLOAT")
PASSES = {"int": (*WHOLE, "BOOLEAN"), "float": (*WHOLE, *BROKEN, "BOOLEAN"), "string": ("STRING",)}

#: Tasks for each core that recipes are dealt over: a file of millions is a few MB, and would be read by one task.
TASKS = 4


def check(recipes: DataFrame, column: str = "recipe") -> DataFrame:
    """Adds `errors` and `warnings` of each JSON recipe: an object with recipe_version x.y.z and algorithms, each an object of parameters of the right kinds.

    Unknown algorithms are warned of, unknown parameters pass, bounds aren't enforced; a landscape_type is a name of PRESETS or empty.
    """
    dealt = recipes.repartition(TASKS * recipes.sparkSession.sparkContext.defaultParallelism)
    # Exploding one element parses and divides each recipe once, not for each of the kinds that are asked of it.
    parsed = dealt.select("*", F.explode(F.array(F.try_parse_json(column))).alias("_parsed"))
    v = F.col("_parsed")
    at = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    parts = {"_kind": _kind(v), "_version": _kind(at("$.recipe_version")), "_all": _kind(at("$.algorithms")), "_own": at("$.algorithms", "map<string,variant>"), "_place": _kind(at("$.landscape_type"))}
    parsed = parsed.select("*", F.inline(F.array(F.struct(*(x.alias(k) for k, x in parts.items())))))
    is_object = F.coalesce(F.col("_kind") == "OBJECT", F.lit(False))
    version, place = at("$.recipe_version", "string"), at("$.landscape_type", "string")
    wrong = [
        F.when(F.col("_version").isNull(), F.lit("recipe_version is missing")).when(~F.coalesce(version.rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)), F.lit("recipe_version isn't x.y.z")),
        F.when(F.col("_all").isNull(), F.lit("algorithms is missing")).when(F.col("_all") != "OBJECT", F.lit("algorithms isn't an object")),
    ]
    lists = [F.array(*wrong)]
    for name, params in DEFINITIONS.items():
        own = F.element_at("_own", name)
        given = {"enabled": ("BOOLEAN",)} | {k: PASSES[x[0]] for k, x in params.items()}
        kinds = [F.when(~_kind(F.try_variant_get(own, f"$.{k}", "variant")).isin(*passes), F.lit(f"{name}.{k} is of another kind")) for k, passes in given.items()]
        # Only what a recipe has is looked into.
        lists.append(F.when(own.isNotNull(), F.when(_kind(own) != "OBJECT", F.array(F.lit(f"{name} isn't an object"))).otherwise(F.array(*kinds))).otherwise(F.array().cast("array<string>")))
    landscape = F.col("_place")
    lists.append(F.array(F.when(landscape.isNotNull() & (landscape != "VOID") & ~F.coalesce((landscape == "STRING") & place.isin("", *PRESETS), F.lit(False)), F.lit("landscape_type is unknown"))))
    names = F.map_keys(F.from_json(F.get_json_object(column, "$.algorithms"), "map<string,string>"))
    unknown = F.coalesce(F.array_except(names, F.array(*map(F.lit, DEFINITIONS))), F.array().cast("array<string>"))
    out = parsed.withColumns(
        {
            "errors": F.when(is_object, F.array_compact(F.concat(*lists))).otherwise(F.array(F.lit("not an object"))),
            "warnings": F.when(is_object, F.transform(unknown, lambda x: F.concat(x, F.lit(" is unknown")))).otherwise(F.array().cast("array<string>")),
        }
    )
    return out.drop("_parsed", *parts)


def presets_of(column: str = "recipe") -> Column:
    """Parameters by algorithm of a JSON recipe, as maps of text: without `enabled` and private names, algorithms without parameters left out."""
    found = F.from_json(F.get_json_object(column, "$.algorithms"), "map<string,string>")
    each = F.transform_values(found, lambda k, x: F.map_filter(F.from_json(x, "map<string,string>"), lambda p, _: (p != "enabled") & ~p.startswith("_")))
    return F.map_filter(each, lambda k, x: F.coalesce(F.size(x), F.lit(0)) > 0)


def exported(name: Column, author: Column, at: Column, algorithms: Column, version: str = "1.0.0") -> Column:
    """A recipe's JSON, stamped with a time in UTC."""
    if not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError("a version is x.y.z")
    stamp = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(F.lit(version).alias("recipe_version"), name.alias("name"), author.alias("author"), stamp.alias("created"), algorithms.alias("algorithms")))


def to_presets(recipe: str) -> dict:
    """Parameters by algorithm, without `enabled` and private keys, algorithms without parameters left out."""
    found = json.loads(recipe).get("algorithms", {})
    out = {k: {p: v for p, v in x.items() if p != "enabled" and not p.startswith("_")} for k, x in found.items() if isinstance(x, dict)}
    return {k: x for k, x in out.items() if x}


def export(algorithms: dict, version: str = "1.0.0", **more) -> str:
    if not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError("a version is x.y.z")
    return json.dumps({"recipe_version": version, "algorithms": algorithms} | more, indent=2, sort_keys=True)
