"""Event histories: treatments, first uses, vocabulary over time, weekly bins, impulse fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def treatments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(user_id, ts, kind): an answer treats the asker, an acceptance the answerer (themselves too), a comment a post's owner.

    posts: (id, kind, parent_id, accepted_id, owner_id, ts); comments: (post_id, user_id, ts). Own answers and own or
    anonymous comments treat nobody."""
    q = posts.where("kind = 'question'").select(F.col("id").alias("qid"), F.col("owner_id").alias("asker"), F.col("accepted_id").alias("acc"), F.col("ts").alias("q_ts"))
    a = posts.where("kind = 'answer'").select(F.col("id").alias("aid"), "parent_id", F.col("owner_id").alias("answerer"), F.col("ts").alias("a_ts"))
    pairs = a.join(q, a["parent_id"] == q["qid"])
    answered = pairs.where("asker <> answerer").select(F.col("asker").alias("user_id"), F.col("a_ts").alias("ts"), F.lit("answer_received").alias("kind"))
    accepted = a.join(q, q["acc"] == a["aid"]).where("answerer IS NOT NULL").select(F.col("answerer").alias("user_id"), F.col("a_ts").alias("ts"), F.lit("answer_accepted").alias("kind"))
    owners = posts.select(F.col("id").alias("post_id"), F.col("owner_id").alias("owner"))
    commented = comments.join(owners, "post_id").where("user_id IS NOT NULL AND owner <> user_id").select(F.col("owner").alias("user_id"), "ts", F.lit("comment_received").alias("kind"))
    return answered.union(accepted).union(commented)


def first_uses(uses: DataFrame) -> DataFrame:
    """(user_id, term, ts, entry_id) of each user's first use of a term: by time, then entry."""
    first = uses.groupBy("user_id", "term").agg(F.min(F.struct("ts", "entry_id")).alias("f"))
    return first.select("user_id", "term", "f.ts", "f.entry_id")


def vocabulary(uses: DataFrame) -> DataFrame:
    """(user_id, entry_id, ts, vocabulary): distinct terms used up to and with each entry."""
    per = first_uses(uses).groupBy("user_id", "entry_id").agg(F.count("*").alias("new"))
    entries = uses.select("user_id", "entry_id", "ts").distinct().join(per, ["user_id", "entry_id"], "left").fillna(0, ["new"])
    order = Window.partitionBy("user_id").orderBy("ts", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return entries.select("user_id", "entry_id", "ts", F.sum("new").over(order).alias("vocabulary"))


def vocabulary_report(trajectory: DataFrame) -> DataFrame:
    """One row: users, entries, and average, greatest and middle (the upper, of two) final vocabulary."""
    last = trajectory.groupBy("user_id").agg(F.max_by("vocabulary", F.struct("ts", "entry_id")).alias("v"), F.count("*").alias("n"))
    # the exact percentile's upper neighbour: the lowest value of at least half the users, from above
    middle = -F.percentile_disc(F.lit(0.5), -F.col("v")) if hasattr(F, "percentile_disc") else F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -v)")
    return last.agg(F.count("*").alias("users"), F.sum("n").alias("entries"), F.avg("v").alias("avg_final"), F.max("v").alias("max_final"), F.ceil(middle).cast("long").alias("median_final"))


def weekly_bins(events: DataFrame, days: int = 7) -> DataFrame:
    """(user_id, bin, n) of every week from a user's first event to the last, empty ones too; bins start at the first."""
    span = F.lit(days * 86_400 * 1_000_000)
    base = events.where("ts IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    bounds = base.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    counts = base.join(bounds, "user_id").groupBy("user_id", F.floor((F.col("us") - F.col("lo")) / span).alias("bin")).agg(F.count("*").alias("n"))
    dense = bounds.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / span))).alias("bin"))
    return dense.join(counts, ["user_id", "bin"], "left").fillna(0, ["n"])


def _simplex(f, x0: np.ndarray, steps: int = 600, tolerance: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """Nelder-Mead minimisation."""
    n = len(x0)
    points = [x0, *(x0 + np.eye(n)[i] * (0.25 if x0[i] == 0 else 0.25 * abs(x0[i])) for i in range(n))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance:
            return points[0], values[0], True
        middle = np.mean(points[:-1], axis=0)
        away = middle + (middle - points[-1])
        v = f(away)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            near = middle + 0.5 * ((away if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    best = int(np.argmin(values))
    return points[best], values[best], False


def impulse_fit(bins: DataFrame, least_events: int = 20, least_treatments: int = 10, relaxed: tuple[int, int] = (5, 3)) -> DataFrame:
    """Per user a mean-reverting process with impulses: user_id, theta, mu, kick, sigma, loss, converged, n.

    bins: (user_id, bin, x, treated): learning events and treatments of each week. x moves from week to week by
    theta (mu - x) + kick treated with normal noise; users with fewer events or treatments than asked aren't fitted. Where
    no user has as many, those with the relaxed numbers are."""
    sums = bins.groupBy("user_id").agg(F.sum("x").alias("_x"), F.sum("treated").alias("_t"))
    enough = lambda events, treatments: (F.col("_x") >= events) & (F.col("_t") >= treatments)
    eligible = sums.where(enough(least_events, least_treatments))
    if eligible.isEmpty():
        eligible = sums.where(enough(*relaxed))
    kept = bins.join(eligible.select("user_id"), "user_id", "left_semi")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        x, t = pdf["x"].to_numpy(float), pdf["treated"].to_numpy(float)

        def loss(p: np.ndarray) -> float:
            theta, mu, kick, log_s = p
            s = np.exp(np.clip(log_s, -10, 10))
            miss = x[1:] - x[:-1] - theta * (mu - x[:-1]) - kick * t[:-1]
            return float(0.5 * np.sum((miss / s) ** 2) + len(miss) * np.log(s))

        start = np.array([0.5, x.mean(), 0.1, np.log(x.std() + 0.1)])
        p, v, done = _simplex(loss, start) if len(x) > 2 else (start, 0.0, False)
        return pd.DataFrame([{"user_id": pdf["user_id"].iloc[0], "theta": p[0], "mu": p[1], "kick": p[2], "sigma": float(np.exp(np.clip(p[3], -10, 10))), "loss": v, "converged": bool(done), "n": len(x)}])

    kind = bins.schema["user_id"].dataType.simpleString()
    return kept.groupBy("user_id").applyInPandas(fit, f"user_id {kind}, theta double, mu double, kick double, sigma double, loss double, converged boolean, n long")
