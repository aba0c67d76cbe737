"""The layer catalog: lookups, filters and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.names import prediction_group, prediction_key


def select_layers(catalog: DataFrame, **filters: object) -> DataFrame:
    """Equality, membership of a list, or a function of the column."""
    for name, want in filters.items():
        c = F.col(name)
        test = want(c) if isinstance(want, Callable) else c.isin(*want) if isinstance(want, (list, tuple, set)) else c == want
        catalog = catalog.filter(test)
    return catalog


def with_tags(catalog: DataFrame, tags: list[str], match_all: bool = False) -> DataFrame:
    want = F.array(*map(F.lit, tags))
    return catalog.filter(F.size(F.array_except(want, "tags")) == 0 if match_all else F.arrays_overlap("tags", want))


def lookup(catalog: DataFrame, name: str, year: int | None = None) -> DataFrame:
    """The layer of a name and year; without a year the only instance; no row if ambiguous."""
    found = catalog.filter(F.col("name") == name)
    if year is not None:
        return found.filter(F.col("year") == year)
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).filter("_n = 1").drop("_n")


def years_per_name(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("name").agg(F.sort_array(F.collect_set("year")).alias("years"), (F.count_distinct("year") > 1).alias("temporal"))


def common_years(catalog: DataFrame) -> DataFrame:
    n = catalog.agg(F.count_distinct("name").alias("_n"))
    per = catalog.filter("year IS NOT NULL").groupBy("year").agg(F.count_distinct("name").alias("_k"))
    return per.join(F.broadcast(n)).filter("_k = _n").select("year")


def all_years(catalog: DataFrame) -> DataFrame:
    """Years that any layer has."""
    return catalog.select("year").filter("year IS NOT NULL").distinct()


def output_key(name: Column, year: Column) -> Column:
    """The key that a layer's harmonised output is registered under."""
    return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(name, F.lit("_"), year.cast("string"))).otherwise(name)


def expected_type(data_type: Column, raster_type: Column, method: Column) -> Column:
    """The raster type of a layer's output: its own, or for polygons categorical if they are burned as unique ids."""
    burned = F.when(method == "unique", "categorical").otherwise("continuous")
    return F.when(data_type == "vector", burned).otherwise(raster_type)


def harmonisation(raw: DataFrame, processed: DataFrame, signature: str | None) -> DataFrame:
    """``(key, status)`` of each layer of ``raw (name, year, data_type, raster_type, method, active, modified_at)``.

    Its output is the row of ``processed (name, year, raster_type, levels, grid_signature, path, modified_at)`` with the same
    key. pending: no output; another type than the layer would get now; a categorical output without levels; an output
    older than its layer; a file that several layers share; another grid. unknown: the grid of the output or of the project
    is not on record. current: the rest. Inactive polygons are not harmonised and have no row.
    """
    key = output_key(F.col("name"), F.col("year"))
    out = processed.withColumn("_key", key).select(
        "_key",
        F.col("raster_type").alias("_type"),
        F.col("levels").alias("_levels"),
        F.col("grid_signature").alias("_sig"),
        F.col("path").alias("_path"),
        F.col("modified_at").alias("_at")
    )
    t = raw.filter((F.col("data_type") != "vector") | F.coalesce("active", F.lit(False))).withColumn("_key", key).join(out, "_key", "left")
    sharing = t.filter("_path IS NOT NULL").groupBy("_path").agg((F.count("*") > 1).alias("_shared"))
    t = t.join(sharing, "_path", "left")
    typed = F.col("_type").eqNullSafe(expected_type(F.col("data_type"), F.col("raster_type"), F.col("method")))
    stale = ~typed |(
        (F.col("_type") == "categorical") & F.col("_levels").isNull()
    ) | (F.col("_at") < F.col("modified_at")) | F.coalesce("_shared", F.lit(False))
    ours = F.lit(signature).cast("string")
    state = (
        F.when(F.col("_path").isNull(), "pending")
        .when(ours.isNull() | F.col("_sig").isNull(), "unknown")
        .when(F.coalesce(stale, F.lit(False)) | (F.col("_sig") != ours), "pending")
        .otherwise("current")
    )
    return t.select(F.col("_key").alias("key"), state.alias("status"))


def without_levels(processed: DataFrame) -> DataFrame:
    """Names of categorical outputs whose levels were never stored."""
    return processed.filter((F.col("raster_type") == "categorical") & F.col("levels").isNull()).select("name").distinct()


def export_nodata(given: Column, raster_type: Column) -> Column:
    """The fill of an export: the given one, -32768 for continuous layers, 255 for others."""
    return F.coalesce(given.cast("int"), F.when(raster_type == "continuous", -32768).otherwise(255))


def change_candidates(catalog: DataFrame) -> DataFrame:
    """Layers that a change can be made of: dated rasters."""
    return catalog.filter((F.col("data_type") != "vector") & F.col("year").isNotNull())


def change_entry(catalog: DataFrame, op: str, start: str, end: str) -> dict[str, object]:
    """What the change layer between the layers of two keys will be: name, paths of its sources, years, and the existing
    path if it is in the catalog already. Raises ValueError for an unknown operation, equal or unknown keys, missing or
    reversed years, and layers of different grids."""
    if op not in ("loss", "gain"):
        raise ValueError(f"unknown change {op!r}")
    if start == end:
        raise ValueError("two different layers are needed")
    keyed = catalog.withColumn("_key", output_key(F.col("name"), F.col("year")))
    found = {r["_key"]: r for r in keyed.filter(F.col("_key").isin(start, end)).collect()}
    for key in (start, end):
        if key not in found:
            raise ValueError(f"no layer {key!r}")
    a, b = found[start], found[end]
    if a["year"] is None or b["year"] is None or a["year"] >= b["year"]:
        raise ValueError("the first layer must be dated before the second")
    if a["grid_signature"] != b["grid_signature"]:
        raise ValueError(f"{start!r} and {end!r} are not on one grid")
    name = f"{op}_{a['name']}_{a['year']}_{b['year']}" if a["name"] == b["name"] else f"{op}_{a['name']}_{a['year']}_{b['name']}_{b['year']}"
    made = keyed.filter(F.col("_key") == name).select("path").first()
    return {"name": name, "sources": (a["path"], b["path"]), "years": (a["year"], b["year"]), "existing": made["path"] if made else None}


def named_layer(catalog: DataFrame, name: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Per ``by`` the first layer (by ``position``) called ``name`` or ``name_<parameters>``."""
    fits = catalog.filter((F.col("name") == name) | F.col("name").startswith(f"{name}_"))
    return fits.groupBy(*by).agg(F.min_by("name", "position").alias("layer"))


def sole_layer(catalog: DataFrame, name: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """As ``named_layer``, but NULL where there are several."""
    fits = catalog.filter((F.col("name") == name) | F.col("name").startswith(f"{name}_"))
    return fits.groupBy(*by).agg(F.when(F.count("*") == 1, F.first("name")).alias("layer"))


def resolve(catalog: DataFrame, target: tuple[str, int | None], features: list[str], years: dict[str, int] | None = None) -> DataFrame:
    """One row a layer of a dataset: ``role, name, year, path``, the target first, then the features in order.

    A layer of several years needs one: a feature's from ``years``, else the target's. ValueError for unknown names, a year
    given for a layer of one year, a missing year, and a year that the layer does not have.
    """
    names = [target[0], *features]
    rows = catalog.filter(F.col("name").isin(names)).select("name", "year", "path").distinct().collect()
    known: dict[str, dict] = {}
    for r in rows:
        known.setdefault(r["name"], {})[r["year"]] = r["path"]
    years, own = dict(years or {}), target[1]
    out = []
    for i, name in enumerate(names):
        if name not in known:
            raise ValueError(f"no layer called {name!r}")
        have, year = known[name], own if i == 0 else years.get(name, own)
        if len([y for y in have if y is not None]) > 1:
            if year is None:
                raise ValueError(f"{name!r} has several years: {sorted(y for y in have if y is not None)}")
            if year not in have:
                raise ValueError(f"{name!r} has no layer of {year}")
        else:
            if (i == 0 and own is not None) or (i > 0 and name in years):
                raise ValueError(f"{name!r} has one layer only: no year is to be given")
            year = next(iter(have))
        out.append(("target" if i == 0 else "feature", i, name, year, have[year]))
    return catalog.sparkSession.createDataFrame(out, "role string, position int, name string, year int, path string")


def grouped_predictions(predictions: DataFrame) -> DataFrame:
    """Maps of one run together: ``(row_key, storage_keys)`` of ``predictions (name, model, dataset, year, window)``."""
    t = predictions.select(
        prediction_group(F.col("name"), F.col("model"), F.col("dataset")).alias("row_key"),
        prediction_key(F.col("model"), F.col("dataset"), F.col("year"), F.col("window")).alias("_key"),
    )
    return t.groupBy("row_key").agg(F.sort_array(F.collect_list("_key")).alias("storage_keys"))


def processed_first(raw: DataFrame, processed: DataFrame) -> DataFrame:
    both = raw.withColumn("_p", F.lit(1)).unionByName(processed.withColumn("_p", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("name", "year").orderBy("_p"))).filter("_r = 1").drop("_p", "_r")


def _file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _combined(tests: list[Column], match_all: bool) -> Column:
    """All or any of the tests; all of none hold, any of none does not."""
    out = F.lit(match_all)
    for t in tests:
        out = out & t if match_all else out | t
    return out


def files_with(catalog: DataFrame, words: list[str], exclude: list[str] = (), match_all: bool = True) -> DataFrame:
    """Files whose name holds all (or any) of the words and none of the excluded ones, in any case."""
    name = _file(F.col("path"))
    holds = lambda w: name.contains(w.lower())
    return catalog.filter(_combined([holds(w) for w in words], match_all) & ~_combined([holds(w) for w in exclude], False))


def files_with_tokens(catalog: DataFrame, tokens: list[str] = (), exclude: list[str] = (), any_of: bool = True, any_excluded: bool = True) -> DataFrame:
    """Files whose name holds any (or all) of the tokens as words of their own, and not any (or not all) of the excluded
    ones. A number needs no word of its own; no tokens fit every file."""
    name = _file(F.col("path"))

    def holds(token: str) -> Column:
        token = token.lower()
        return name.contains(token) if token.isdigit() else name.rlike(f"(?<![0-9a-z])\\Q{token}\\E(?![0-9a-z])")

    wanted = _combined([holds(t) for t in tokens], not any_of) if tokens else F.lit(True)
    barred = _combined([holds(t) for t in exclude], not any_excluded) if exclude else F.lit(False)
    return catalog.filter(wanted & ~barred)


# The words in a file's name by which it plays a role in a period; {first} and {last} are its years.
ROLE_WORDS = {
    "altitude": ["altitude"], "slope": ["slope"], "pa": ["pa"], "subj": ["subj"],
    "dist_river": ["rivers", "reprojected", "distance"], "dist_road": ["roads", "reprojected", "distance"],
    "dist_town": ["{first}", "town", "reprojected", "distance"], "fcc": ["{first}", "{last}", "forest", "loss"],
    "dist_edge": ["{first}", "forest", "reprojected", "edge"],
}


def role_files(catalog: DataFrame, periods_: DataFrame, source: str = "") -> DataFrame:
    """``(name, period, files map<role, path>)``: the first file (by path) of each role, for ``periods_ (name, period,
    initial_year, final_year)``; roles without a file are left out. ``source`` must be in the names of forest files."""
    name, tests = _file(F.col("path")), []
    for role, words in ROLE_WORDS.items():
        more = [source.lower()] if source and role in ("fcc", "dist_edge") else []
        fit = F.lit(True)
        for w in [*words, *more]:
            needed = F.col("initial_year").cast("string") if w == "{first}" else F.col("final_year").cast("string") if w == "{last}" else F.lit(w)
            fit = fit & name.contains(needed)
        tests.append(F.when(fit & ~(name.contains("edge") if role == "fcc" else F.lit(False)), F.lit(role)))
    roles = F.explode(F.array_compact(F.array(*tests))).alias("_role")
    met = catalog.select("path").distinct().crossJoin(F.broadcast(periods_.select("name", "period", "initial_year", "final_year")))  # four periods a name
    first = met.select("name", "period", "path", roles).groupBy("name", "period", "_role").agg(F.min("path").alias("_path"))
    return first.groupBy("name", "period").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_role", "_path")))).alias("files"))


def periods(dates: DataFrame) -> DataFrame:
    """The four periods of each row ``(name, y1, y2, y3)``; layer_year is that of the forest the period starts from."""
    y = [F.col(f"y{i}") for i in (1, 2, 3)]

    def one(period: str, trained_on: str, start: Column, end: Column, lost: list[int], layer: Column) -> Column:
        parts ={
            "period": F.lit(period),
            "train_period": F.lit(trained_on),
            "initial_year": start,
            "final_year": end,
            "defor_values": F.array(*map(F.lit, lost)),
            "time_interval": end - start,
            "layer_year": layer
        }
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    rows = [
        one("calibration", "calibration", y[0], y[1], [1], y[0]),
        one("validation", "calibration", y[1], y[2], [1], y[1]),
        one("historical", "historical", y[0], y[2], [1, 2], y[0]),
        one("forecast", "historical", y[0], y[2], [1, 2], y[2]),
    ]
    return dates.select("name", F.explode(F.array(*rows)).alias("p")).select("name", "p.*")


# Where a rate table may come from, best first, and the kinds of map each applies to (None: all).
RATE_SOURCES = [("user", None), ("evaluation", ["import"]), ("persisted", ["mw", "jnr", "other"]), ("sibling", ["mw"]), ("computed", ["other"])]


def rate_table_source(candidates: DataFrame) -> DataFrame:
    """``(prediction, source, path)`` chosen from ``candidates (prediction, kind, source, path, made_at)``: by source, then
    the newest, then the smallest path. Predictions without a fitting candidate have no row; NULL paths do not count."""
    rank = None
    for i, (source, kinds) in enumerate(RATE_SOURCES):
        fits = (F.col("source") == source) & (F.col("kind").isin(kinds) if kinds else F.lit(True))
        rank = F.when(fits, i) if rank is None else rank.when(fits, i)
    t = candidates.filter(F.col("path").isNotNull()).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = F.min(F.struct("_rank", (-F.unix_micros(F.col("made_at").cast("timestamp"))).alias("_age"), "path", "source"))
    return t.groupBy("prediction").agg(best.alias("b")).select("prediction", "b.source", "b.path")
