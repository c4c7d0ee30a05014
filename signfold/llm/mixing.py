"""Mixing sources to target weights by soft membership.

A labelled table trains a naive Bayes classifier over words and text statistics; its posteriors say how much of a
document belongs to each domain. Nonnegative rates of the documents are then fitted by distributed projected
gradient steps to

    1/2 sum_k ((sum_d r_d t_d p_dk - w_k S) / S)^2 + ridge/2 sum_d (t_d / S) (r_d - 1)^2 / c_d,    r >= 0,

t the tokens of a document, p its posteriors, S all tokens, w the target weights, c_d = 1 / (p_d . q + ridge) with q
the domains' shares as they are: the expected tokens of each domain match the targets, and rates stay as close to 1
as that allows, those of documents of rare domains being freer to move. Every document has its rate as state. A step
takes the expected shares of the domains, an aggregation of k sums, to the driver, which gives every document its
gradient; scales the gradient of the free documents (rate above 0, or at 0 and drawn upwards) by their curvature,
k * k more sums; moves every rate against it and projects it to r >= 0. A step that does not lower the objective is
halved, and at last replaced by a plain gradient step of a length that does. Steps since the last writing are part
of the projection, and every WRITE_STEPS of them the rates are written down, so that neither the plan nor the work
of a step grows with the steps before.

The fit tells how far it got: the rows carry `target_gap`, the largest difference of an expected share from its
target, and `converged`, whether the last step moved rates by no more than the tolerance. Targets that no rates
reach (a domain without documents) leave a gap; they are no error.

Only DataFrame functions are used. Words and statistics are counted on at most `most_rows` labelled rows (those
of smallest hash); the LEXICON most telling words are part of the model. Everything else covers all rows.

Defined results: null and empty texts have no tokens, the prior as posteriors and, as nothing depends on them,
rate 1; labels that are null or not among the targets are left out, of several labels of one id the smallest
counts; labels of a null id teach nothing; without labels posteriors are uniform; repeated rows are documents of
their own, with equal posteriors and rates; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, ident, restored, texts, written

MOST_ROWS = 20_000
LEXICON = 64
STEPS = 40
#: Times that a step is halved.
HALVINGS = 5
#: Least relative fall of the objective that a step must bring.
ENOUGH = 1e-9
#: Steps that a projection holds before rates are written down.
WRITE_STEPS = 8
#: A word of smaller spread than this could owe it to chance among millions of words.
TELLING = 15.0
RIDGE = 1e-4
#: Average movement of the rates, weighted by tokens, below which steps end.
TOLERANCE = 1e-5
#: Upper ends of the cells of each statistic.
CELLS = {
    "symbols": (0.0005, 0.002, 0.01, 0.03, 0.1),
    "capitals": (0.005, 0.015, 0.03, 0.06, 0.15, 0.4),
    "distinct": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85),
    "length": (20, 60, 150, 400, 1500),
    "digits": (0.0005, 0.005, 0.02, 0.06),
}


def described(docs: DataFrame, key: str, text: str, lexicon: list[str] | None = None) -> DataFrame:
    """(key, tokens, words: the distinct ones, of the lexicon only if there is one, c_<statistic>: its cell).

    One projection does all that looks at the text, so that word arrays are made once and none is carried on.
    """
    # Plain replacements and a split at one character spare a regular expression.
    spaced = F.lower("text")
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    w = F.array_remove(F.split(spaced, " ", -1), "")
    distinct = F.array_distinct(w)
    size = F.greatest(F.length("text"), F.lit(1))
    words = distinct if lexicon is None else F.array_intersect(w, F.array(*[F.lit(x) for x in lexicon]).cast("array<string>"))
    shares = [(F.regexp_count("text", F.lit(c)) / size).alias(n) for n, c in (("symbols", "[#$%&*|!]"), ("capitals", "[A-Z]"), ("digits", "[0-9]"))]
    t = texts(docs, key, text).select(key, F.size(w).cast("bigint").alias("tokens"), F.size(distinct).alias("n_distinct"), words.alias("words"), *shares)
    t = t.withColumn("distinct", F.when(F.col("tokens") > 0, F.col("n_distinct") / F.col("tokens")).otherwise(F.lit(0.0))).withColumn("length", F.col("tokens").cast("double"))

    def cell(name: str) -> Column:
        out = F.lit(len(CELLS[name]))
        for i in range(len(CELLS[name]) - 1, -1, -1):
            out = F.when(F.col(name) <= float(CELLS[name][i]), F.lit(i)).otherwise(out)
        return out.alias(f"c_{name}")

    return t.select(key, "tokens", "words", *[cell(c) for c in CELLS])


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", most_rows: int = MOST_ROWS) -> dict:
    """Log posteriors' parts: prior by domain, by statistic and cell, by telling word (log-likelihood of its presence relative to its absence)."""
    k = len(domains)
    rows = labelled.filter(F.col(domain).isin(domains)).groupBy(ident(key).alias(key)).agg(F.min(domain).alias("domain"))
    chosen = rows.orderBy(F.xxhash64(key), key).limit(most_rows)
    chosen = written(chosen, "chosen")
    picked = texts(docs, key, text).join(F.broadcast(chosen.select(key)), key, "left_semi")
    seen = written(described(picked, key, "text").join(F.broadcast(chosen), key), "labelled")
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    spent, seen = [seen], seen.withColumn("k", number)
    totals = {r.k: r.n for r in seen.groupBy("k").agg(F.count("*").alias("n")).collect()}
    n = [totals.get(i, 0) for i in range(k)]
    model = {"prior": [math.log((x + 1) / (sum(n) + k)) for x in n], "cells": {}, "words": {}}
    for name in CELLS:
        width = len(CELLS[name]) + 1
        found = {(r.k, r.c): r.n for r in seen.groupBy("k", F.col(f"c_{name}").alias("c")).agg(F.count("*").alias("n")).collect()}
        model["cells"][name] = [[math.log((found.get((i, c), 0) + 1) / (n[i] + width)) for i in range(k)] for c in range(width)]
    per = seen.select("k", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("k") == i).alias(f"n{i}") for i in range(k)])

    def log_odds(i: int) -> Column:
        share = (F.col(f"n{i}") + 0.5) / (n[i] + 1)
        return F.log(share / (F.greatest(F.lit(1.0) - share, F.lit(1e-6))))

    logs = [(F.col(f"n{i}") + 0.5) / (n[i] + 1) for i in range(k)]
    # How telling: the spread of the word's shares, weighted by its rows.
    spread = sum((F.col(f"n{i}") * F.log(logs[i] / (sum(F.col(f"n{j}") for j in range(k)) + 0.5) * (sum(n) + 1)) for i in range(k)), F.lit(0.0))
    telling = per.withColumn("spread", spread).filter(F.col("spread") > TELLING).orderBy(F.desc("spread"), "word").limit(LEXICON)
    for r in telling.select("word", *[log_odds(i).alias(f"l{i}") for i in range(k)]).collect():
        values = [r[f"l{i}"] for i in range(k)]
        # Only differences between domains matter.
        middle = sum(values) / k
        model["words"][r.word] = [v - middle for v in values]
    discard(chosen, *spent)
    return model


def posteriors(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, p: array of posteriors in the order of the domains)."""

    def row(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    logs = row(model["prior"])
    for name, cells in model["cells"].items():
        logs = added(logs, F.element_at(F.array(*[row(c) for c in cells]), F.col(f"c_{name}") + 1))
    lexicon = sorted(model["words"])
    if lexicon:
        known, values = F.array(*[F.lit(w) for w in lexicon]), F.array(*[row(model["words"][w]) for w in lexicon])
        logs = F.aggregate("words", logs, lambda acc, w: F.zip_with(acc, F.element_at(values, F.array_position(known, w).cast("int")), lambda x, y: x + y))
    d = described(docs, key, text, lexicon).withColumn("logs", F.when(F.col("tokens") > 0, logs).otherwise(row(model["prior"])))
    d = d.withColumn("top", F.array_max("logs")).withColumn("e", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("total", total).select(key, "tokens", F.transform("e", lambda x: x / F.col("total")).alias("p"))


class Fit(NamedTuple):
    """Expected shares of all tokens, the largest difference from a target, steps taken, movement of the last one, whether that was small."""

    shares: list[float]
    gap: float
    steps: int
    moved: float
    converged: bool


def fit_rates(members: DataFrame, weights: list[float], ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, Fit]:
    """members: tokens, p and any more columns, none of them `rate` or `_scale`. Returns them with `rate`, and how the fit went."""
    k, w = len(weights), np.array(weights)
    p, columns = [F.col("p")[i] for i in range(k)], members.columns
    first = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * x) for x in p]).first()
    total = float(first[0] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0)), Fit([0.0] * k, float(w.max()), 0, 0.0, True)
    held = [float(x) / total for x in first[1:]]

    def dot(values) -> Column:
        return sum((x * F.lit(float(v)) for x, v in zip(p, values)), F.lit(0.0))

    # A document's own curvature is the share of its domains; the ridge bounds the scale where that is next to nothing.
    scale = F.lit(1.0) / (dot(held) + F.lit(ridge))
    table = written(members.withColumns({"_scale": scale, "rate": F.lit(1.0)}), "rates")
    weight = F.col("tokens") * F.col("_scale")
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def curvature(df: DataFrame, free: Column) -> tuple[np.ndarray, np.ndarray]:
        """Of the free documents: sums of scale * p * p and of p."""
        row = df.filter(free).agg(*[F.sum(weight * p[i] * p[j]) for i, j in upper], *[F.sum(F.col("tokens") * x) for x in p]).first()
        values = [float(x or 0) / total for x in row]
        curve = np.zeros((k, k))
        for (i, j), x in zip(upper, values):
            curve[i, j] = curve[j, i] = x
        return curve, np.array(values[len(upper) :])

    def moved_to(size: float, pull: np.ndarray) -> Column:
        """rate - size * (scale * p . pull + rate - 1), projected."""
        moved = F.col("rate") * F.lit(1 - size) - F.lit(size) * (F.col("_scale") * dot(pull) - F.lit(1.0))
        return F.greatest(F.lit(0.0), moved)

    def measured(df: DataFrame, choices: list[Column]) -> list[tuple[np.ndarray, float, float]]:
        """Of each choice of rates the expected shares, the objective and the average movement; all in one aggregation."""
        named = [F.col(f"_c{n}") for n in range(len(choices))]
        df = df.withColumns({f"_c{n}": c for n, c in enumerate(choices)})
        sums = []
        for c in named:
            far = F.sum(F.col("tokens") * (c - 1) * (c - 1) / F.col("_scale"))
            sums += [F.sum(F.col("tokens") * F.abs(c - F.col("rate"))), far, *[F.sum(c * F.col("tokens") * x) for x in p]]
        values, out = [float(x) / total for x in df.agg(*sums).first()], []
        for n in range(len(choices)):
            step, far, *found = values[n * (k + 2) : (n + 1) * (k + 2)]
            found = np.array(found)
            out.append((found, float(((found - w) ** 2).sum() + ridge * far) / 2, step))
        return out

    largest = float(np.linalg.eigvalsh(curvature(table, F.lit(True))[0])[-1])
    state, pending, taken, moved = table, 0, 0, math.inf
    shares, value, _ = measured(state, [F.col("rate")])[0]
    while taken < steps and moved > tolerance:
        error = shares - w
        free = (F.col("rate") > 0) | (F.col("_scale") * dot(error) + F.lit(ridge) * (F.col("rate") - 1) < 0)
        curve, held = curvature(state, free)
        # The curvature is ridge plus a matrix of rank k, so scaling by its inverse takes a k * k system.
        answer = np.linalg.solve(curve + ridge * np.eye(k), curve @ error + ridge * (shares - held))
        # A plain gradient step is the last resort: shorter than the largest curvature allows, it lowers the objective.
        tries = [*((0.5**n, (error - answer) / ridge) for n in range(HALVINGS)), (ridge / (largest + ridge), error / ridge)]
        found = measured(state, [moved_to(*x) for x in tries])
        best = next((n for n, x in enumerate(found) if x[1] < value * (1 - ENOUGH)), None)
        if best is None:
            # Nothing is lowered beyond rounding: this is the minimum.
            moved = 0.0
            break
        state, pending, taken = state.withColumn("rate", moved_to(*tries[best])), pending + 1, taken + 1
        shares, value, moved = found[best]
        if pending == WRITE_STEPS:
            past, table, pending = table, written(state, "rates"), 0
            state = table
            discard(past)
    out = state.select(*columns, F.when(F.col("tokens") > 0, F.col("rate")).otherwise(1.0).alias("rate"))
    out.spent = [table]
    return out, Fit(shares.tolist(), float(np.abs(shares - w).max()), taken, moved, moved <= tolerance)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", **how) -> DataFrame:
    """Per row: key, tokens, p_<domain> (posterior), rate, and of the whole fit target_gap and converged.

    labelled: (key, domain). targets: weight of each domain; they are normalised to sum to 1.
    """
    domains = list(targets)
    whole = sum(targets.values())
    if not domains or min(targets.values()) < 0 or whole <= 0:
        raise ValueError("targets must be nonnegative weights with a positive sum")
    model = train(docs, labelled, domains, key, text, domain)
    members = written(posteriors(docs, model, key, text), "posteriors")
    rates, fit = fit_rates(members, [targets[d] / whole for d in domains], **how)
    spent = getattr(rates, "spent", [members])
    if spent != [members]:
        discard(members)
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    out = restored(rates.select(key, "tokens", *shares, "rate", F.lit(fit.gap).alias("target_gap"), F.lit(fit.converged).alias("converged")), key)
    out.spent = spent
    return out
