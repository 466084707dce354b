"""Consensus labels from annotators who disagree: latent ability and difficulty (GLAD), several classes.

P(user u gives item i its true label) = 1 / (1 + exp(-alpha_u * beta_i)), errors spread over the other classes. An item's
labels are gathered into one row (one per user at most, so its size is bounded by the number of users). Expectation:
each item's label posterior and its difficulty 1 / beta_i, from the abilities alone. Maximisation: a gradient step on the
abilities from sums over items, partly aggregated where the items lie; the abilities, one number per user and field, are
all that travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.session import cut_lineage

MAX_ITERATIONS, TOLERANCE = 30, 0.003
INNER_STEPS = 6  # gradient steps on an item's difficulty
PRIOR_ALPHA, PRIOR_BETA = (2.0, 1.0), (0.0, 0.5)  # mean and deviation of alpha and of log beta
MIN_USERS = 3
MAX_USERS = 1_000_000  # the abilities are one number per user: what the tasks are sent, at most; more fail the job

# The label sets.
LABELS = {
    "ana_departman": "housekeeping front_office food_beverage spa_wellness technical security animation guest_relations".split(),
    "genel_duygu": "olumlu olumsuz notr".split(),
}


def canonical_label(c: Column) -> Column:
    """Lower case, dotless and umlaut letters folded, blanks and hyphens as underscores."""
    low = F.lower(F.translate(F.trim(c), "İIıöÖ", "iiioo"))
    return F.regexp_replace(low, r"[\s\-_]+", "_")


def latest_labels(corrections: DataFrame) -> DataFrame:
    """Per user and item the latest non-NULL label that belongs to the field's set: review_id, field_name, user_id, label (index).

    Copies and double submissions fall together; of equal times the larger id counts. Rows without user or review are left out.
    """
    known = F.create_map(*[x for f, names in LABELS.items() for i, n in enumerate(names) for x in (F.lit(f"{f}|{n}"), F.lit(i))])
    label = F.element_at(known, F.concat("field_name", F.lit("|"), canonical_label(F.col("corrected_value"))))
    rows = corrections.where(F.col("field_name").isin(*LABELS)).select("review_id", "field_name", "user_id", "created_at", "id", label.alias("label")).where("label IS NOT NULL AND user_id IS NOT NULL AND review_id IS NOT NULL")
    return rows.groupBy("review_id", "field_name", "user_id").agg(F.max_by("label", F.struct("created_at", "id")).alias("label"))


def items_of(labels: DataFrame, min_users: int = MIN_USERS) -> DataFrame:
    """One row per item with its users and labels as arrays in user order."""
    pairs = labels.groupBy("review_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("user_id", "label"))).alias("p"))
    return pairs.where(F.size("p") >= min_users).select("review_id", "field_name", F.col("p.user_id").alias("users"), F.col("p.label").alias("labels"))


def solve(users: list[np.ndarray], labels: list[np.ndarray], alpha: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors and difficulties of items, given abilities.

    users and labels hold an array per item. Returns posterior (items x k), log beta, and per label row: user, alpha
    gradient, curvature.
    """
    n = len(users)
    item = np.repeat(np.arange(n), [len(u) for u in users])
    u, y = np.concatenate(users), np.concatenate(labels)
    a = alpha[u]
    log_beta = np.full(n, PRIOR_BETA[0])
    hit = np.zeros((len(u), k))
    hit[np.arange(len(u)), y] = 1.0

    def posterior(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = a * b[item]
        right = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
        log_right, log_wrong = np.log(right), np.log((1 - right) / (k - 1))
        score = np.zeros((n, k))
        np.add.at(score, item, hit * log_right[:, None] + (1 - hit) * log_wrong[:, None])
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True), right

    for _ in range(INNER_STEPS):
        b = np.exp(log_beta)
        p, right = posterior(b)
        mine = p[item, y]  # how likely each label is right
        grad = np.bincount(item, (mine - right) * a * b[item], n) - (log_beta - PRIOR_BETA[0]) / PRIOR_BETA[1] ** 2
        curve = np.bincount(item, right * (1 - right) * (a * b[item]) ** 2, n) + 1 / PRIOR_BETA[1] ** 2
        log_beta = np.clip(log_beta + np.clip(grad / curve, -0.7, 0.7), -3, 3)
    b = np.exp(log_beta)
    p, right = posterior(b)
    mine = p[item, y]
    return p, log_beta, u, (mine - right) * b[item], right * (1 - right) * b[item] ** 2


def fit(spark: SparkSession, items: DataFrame) -> tuple[dict[str, list[str]], dict[str, np.ndarray], int]:
    """Users and abilities per field by expectation-maximisation; items should be written or checkpointed."""
    names: dict[str, list[str]] = {f: [] for f in LABELS}
    rows = items.select("field_name", F.explode("users").alias("u")).distinct().limit(MAX_USERS + 1).collect()
    if len(rows) > MAX_USERS:
        raise ValueError(f"more than {MAX_USERS} annotators: too many to broadcast")
    for r in rows:
        names[r.field_name].append(r.u)
    names = {f: sorted(v) for f, v in names.items()}
    alpha = {f: np.full(len(v), PRIOR_ALPHA[0]) for f, v in names.items()}
    steps = 0
    for steps in range(1, MAX_ITERATIONS + 1):
        shared = spark.sparkContext.broadcast((names, alpha))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, alpha = shared.value
            index = {f: {u: i for i, u in enumerate(v)} for f, v in names.items()}
            g, h = {f: np.zeros(len(v)) for f, v in names.items()}, {f: np.zeros(len(v)) for f, v in names.items()}
            for pdf in batches:
                for f, part in pdf.groupby("field_name"):
                    users = [np.array([index[f][u] for u in us]) for us in part["users"]]
                    _, _, u, grad, curve = solve(users, [np.asarray(y) for y in part["labels"]], alpha[f], len(LABELS[f]))
                    g[f] += np.bincount(u, grad, len(g[f]))
                    h[f] += np.bincount(u, curve, len(h[f]))
            for f in names:
                some = np.flatnonzero(h[f])
                yield pd.DataFrame({"field_name": f, "u": some, "g": g[f][some], "h": h[f][some]})

        total = items.mapInPandas(sums, "field_name string, u bigint, g double, h double").groupBy("field_name", "u").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # a row per user and field
        moved = 0.0
        new = {f: a.copy() for f, a in alpha.items()}
        for r in total:
            a = alpha[r.field_name][r.u]
            step = (r.g - (a - PRIOR_ALPHA[0]) / PRIOR_ALPHA[1] ** 2) / (r.h + 1 / PRIOR_ALPHA[1] ** 2)
            step = float(np.clip(step, -1.0, 1.0))
            new[r.field_name][r.u] = a + step
            moved = max(moved, abs(step))
        alpha = new
        shared.unpersist()
        if moved < TOLERANCE:
            break
    return names, alpha, steps


def consensus(items: DataFrame, names: dict[str, list[str]], alpha: dict[str, np.ndarray]) -> DataFrame:
    """Per item: label, posterior, agreement (share of user pairs that agree), n_users, difficulty (1 / beta)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {f: {u: i for i, u in enumerate(v)} for f, v in names.items()}
        for pdf in batches:
            for f, part in pdf.groupby("field_name"):
                users = [np.array([index[f][u] for u in us]) for us in part["users"]]
                labels = [np.asarray(y) for y in part["labels"]]
                p, log_beta, *_ = solve(users, labels, alpha[f], len(LABELS[f]))
                top = p.argmax(1)
                counts = [np.bincount(y) for y in labels]
                agree = [float((c * (c - 1)).sum() / (c.sum() * (c.sum() - 1))) if c.sum() > 1 else None for c in counts]
                yield pd.DataFrame({"review_id": part["review_id"].to_numpy(), "field_name": f, "label": [LABELS[f][i] for i in top], "posterior": p.max(1), "agreement": agree, "n_users": [len(u) for u in users], "difficulty": np.exp(-log_beta)})

    return items.mapInPandas(run, "review_id string, field_name string, label string, posterior double, agreement double, n_users int, difficulty double")


def reliabilities(spark: SparkSession, items: DataFrame, result: DataFrame, names: dict[str, list[str]], alpha: dict[str, np.ndarray]) -> DataFrame:
    """Per user and field: ability, how many items, and the share of them where the user has the consensus label."""
    rows = [(f, u, float(a)) for f, v in names.items() for u, a in zip(v, alpha[f])]
    ability = spark.createDataFrame(rows, "field_name string, user_id string, ability double")
    index = F.create_map(*[x for f, ns in LABELS.items() for i, n in enumerate(ns) for x in (F.lit(f"{f}|{n}"), F.lit(i))])
    each = items.join(result, ["review_id", "field_name"]).select("field_name", F.element_at(index, F.concat("field_name", F.lit("|"), "label")).alias("top"), F.explode(F.arrays_zip("users", "labels")).alias("x"))
    share = each.groupBy("field_name", F.col("x.users").alias("user_id")).agg(F.count("*").alias("n_items"), F.avg((F.col("x.labels") == F.col("top")).cast("double")).alias("consensus_share"))
    return ability.join(share, ["field_name", "user_id"])


def krippendorff(items: DataFrame) -> DataFrame:
    """Nominal alpha per field: 1 - observed / expected disagreement, chance from the field's label totals."""
    each = items.select("review_id", "field_name", F.size("users").alias("m"), F.explode("labels").alias("label"))
    per = each.groupBy("review_id", "field_name", "m", "label").agg(F.count("*").alias("c"))
    observed = per.groupBy("field_name").agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("d"), F.sum("c").alias("n"))
    totals = per.groupBy("field_name", "label").agg(F.sum("c").alias("t"))
    expected = totals.join(observed, "field_name").groupBy("field_name").agg(F.sum(F.col("t") * (F.col("n") - F.col("t")) / (F.col("n") - 1)).alias("e"))
    return observed.join(expected, "field_name").select("field_name", F.col("n").alias("labels"), (1 - F.col("d") / F.col("e")).alias("alpha"))


def prepared(corrections: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """The items as a checkpointed table. Given assignments, only labels of users who have any count."""
    labels = latest_labels(corrections)
    if assignments is not None:
        labels = labels.join(assignments.select("user_id").distinct(), "user_id", "left_semi")
    return cut_lineage(items_of(labels))
