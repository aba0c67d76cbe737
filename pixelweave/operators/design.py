"""Designs of event models: scaled numbers, treatment-coded categories, and linear predictors as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import logistic
from pixelweave.operators.ranks import quantiles


@dataclass(frozen=True)
class ModelSpec:
    """What a model is made of. Levels are all values that a categorical layer can take, the reference first."""

    target: str
    continuous: tuple[str, ...] = ()
    categorical: dict[str, tuple] = field(default_factory=dict)
    #: Mean and population deviation of each continuous feature over the training rows.
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.continuous, *self.categorical)

    def formula(self, levels: bool = True) -> str:
        parts = [f"scale({c})" for c in self.continuous]
        parts += [f"C({c}, levels={list(v)})" if levels else f"C({c})" for c, v in self.categorical.items()]
        return f"I({self.target}) + trial ~ {' + '.join(parts) or '1'}"

    def terms(self) -> list[str]:
        """Column names of the design, without the intercept: categories first, as a formula's expansion has them."""
        coded = [f"C({c}, levels={list(v)})[T.{k}]" for c, v in self.categorical.items() for k in v[1:]]
        return coded + [f"scale({c})" for c in self.continuous]

    def columns(self) -> list[Column]:
        """The design's columns, in the order of ``terms``; a value that is no level is NULL."""
        out = []
        for c, values in self.categorical.items():
            out += [F.when(F.col(c).isin(*values), (F.col(c) == k).cast("double")) for k in values[1:]]
        for c in self.continuous:
            mean, sd = self.scaling[c]
            out.append((F.col(c).cast("double") - F.lit(mean)) / F.lit(sd))
        return out

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows with a value in every feature."""
        return df.dropna(subset=list(self.features)) if self.features else df

    def frozen(self, df: DataFrame) -> ModelSpec:
        """The spec with the scaling of the complete rows of ``df`` that have a target."""
        if not self.continuous:
            return self
        rows = self.complete(df).dropna(subset=[self.target])
        got = rows.agg(*[f(F.col(c).cast("double")) for c in self.continuous for f in (F.avg, F.stddev_pop)]).first()
        scaling = {}
        for i, c in enumerate(self.continuous):
            mean, sd = got[2 * i], got[2 * i + 1]
            if not sd:
                raise ValueError(f"feature {c!r} does not vary over the training rows")
            scaling[c] = (float(mean), float(sd))
        return ModelSpec(self.target, self.continuous, self.categorical, scaling)

    def unseen(self, df: DataFrame, most: int = 10) -> DataFrame:
        """``(variable, value)``: up to ``most`` values a variable that are no level of it, NULL not among them."""
        each = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"),
                        F.col(c).cast("double").alias("value"),
                        F.col(c).isin(*v).alias("known")
                    ) for c, v in self.categorical.items()
                ]
            )
        )
        odd = df.select(each.alias("e")).select("e.*").filter("value IS NOT NULL AND NOT known").groupBy("variable", "value").agg(F.lit(1).alias("_n"))
        kept = odd.groupBy("variable").agg(F.slice(F.sort_array(F.collect_set("value")), 1, most).alias("values"))
        return kept.select("variable", F.explode("values").alias("value"))

    def require_known(self, df: DataFrame) -> None:
        """ValueError if a category of ``df`` is no level."""
        if self.categorical and (rows := self.unseen(df).collect()):
            raise ValueError("values that are no level: " + ", ".join(f"{r['variable']}={r['value']:g}" for r in rows[:10]))


def from_roles(target: str, roles: dict[str, str], levels: dict[str, tuple]) -> ModelSpec:
    """A spec from feature -> raster type: categorical ones with their levels, all others continuous. ValueError without a
    target or features, or for a categorical feature without levels."""
    if not target or not roles:
        raise ValueError("a target and features are needed")
    missing = [c for c, kind in roles.items() if kind == "categorical" and not levels.get(c)]
    if missing:
        raise ValueError(f"categorical features without levels: {missing}")
    return ModelSpec(target, tuple(c for c, k in roles.items() if k != "categorical"), {c: tuple(levels[c]) for c, k in roles.items() if k == "categorical"})


def linear_predictor(spec: ModelSpec, coefs: dict[str, float]) -> Column:
    """Sum of the intercept, a looked-up coefficient per category and the scaled numbers. A category that is no level raises
    when its row is read; NULL features give NULL."""
    eta = F.lit(float(coefs.get("Intercept", 0.0)))
    for c, values in spec.categorical.items():
        at = F.when(F.col(c) == values[0], F.lit(0.0))
        for k in values[1:]:
            at = at.when(F.col(c) == k, F.lit(float(coefs[f"C({c}, levels={list(values)})[T.{k}]"])))
        odd = F.raise_error(F.concat(F.lit(f"{c}: value is no level of the training: "), F.col(c).cast("string"))).cast("double")
        eta = eta + F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(at.otherwise(odd))
    for c in spec.continuous:
        mean, sd = spec.scaling[c]
        eta = eta + F.lit(float(coefs[f"scale({c})"])) * ((F.col(c).cast("double") - F.lit(mean)) / F.lit(sd))
    return eta


def design_rows(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Training rows as ``(_y, _x0, _x1, ...)``: complete, with a target, in the order of ``spec.terms()``."""
    rows = spec.complete(df).dropna(subset=[spec.target])
    return rows.select(F.col(spec.target).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(spec.columns())])


def fitted(df: DataFrame, spec: ModelSpec, max_iter: int = 1000) -> tuple[ModelSpec, dict[str, float]]:
    """The spec with its scaling and the coefficients by term: ridge logistic regression on the design of ``df``."""
    from pixelweave.operators.models import glm_fit

    spec = spec.frozen(df)
    spec.require_known(df)
    t = design_rows(df, spec)
    rows = glm_fit(t, "_y", [c for c in t.columns if c != "_y"], max_iter).collect()
    names = {"Intercept": "Intercept"} | {f"_x{i}": term for i, term in enumerate(spec.terms())}
    return spec, {names[r["term"]]: r["estimate"] for r in rows}


def applied(px: DataFrame, spec: ModelSpec, coefs: dict[str, float], effect: str | None = None, keep: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """``keep`` and ``p`` of the complete pixels; ``effect`` names a column to add to the linear predictor."""
    eta = linear_predictor(spec, coefs)
    if effect:
        eta = eta + F.col(effect)
    return spec.complete(px).select(*keep, logistic(eta).alias("p"))


def coefficient_table(spark, coefs: dict[str, float]) -> DataFrame:
    """``(term, estimate)``; a number that is not finite is NULL."""
    rows = [(k, float(v) if np.isfinite(v) else None) for k, v in coefs.items()]
    return spark.createDataFrame(rows, "term string, estimate double")


def fit_statistics(df: DataFrame, spec: ModelSpec, coefs: dict[str, float]) -> DataFrame:
    """One row of a fit: rows, events, deviance and the deviance of the intercept alone."""
    from pixelweave.operators.stats import deviance

    rows = spec.complete(df).dropna(subset=[spec.target])
    scored = rows.select(F.col(spec.target).cast("double").alias("y"), logistic(linear_predictor(spec, coefs)).alias("p"))
    n = scored.agg(F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_events"))
    return n.crossJoin(F.broadcast(deviance(scored, "y", "p")))  # one row each


def importance_table(spark, names: list[str], values: list[float]) -> DataFrame:
    """``(variable, importance)``, largest first; the intercept is left out."""
    rows = sorted(((n, float(v)) for n, v in zip(names, values, strict=True) if n != "Intercept"), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "variable string, importance double")


def posterior_table(trace: DataFrame) -> DataFrame:
    """``(term, estimate, std, ci_low, ci_high, rhat, ess)`` of ``trace (iter, param, value)``."""
    from pixelweave.operators.stats import effective_sample_size, split_rhat

    mean = trace.groupBy("param").agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("std"))
    ends = quantiles(trace, "value", [0.025, 0.975], ["param"]).toDF("param", "ci_low", "ci_high")
    out = mean.join(ends, "param", "left").join(split_rhat(trace), "param", "left").join(effective_sample_size(trace), "param", "left")
    return out.withColumnRenamed("param", "term")
