"""Sources mixed to target weights by entropy balancing.

Rates nearest (in relative entropy) to one copy of each record, under a token
constraint for each source and a cap, are exponentially tilted by record size:
``min(cap, exp(lambda * tokens / mean))``.  The convex dual separates by source;
its Newton steps need two sums over a histogram of sizes, which are taken by a
distributed aggregation for all mixes at once.  Rates become copies by
systematic rounding along the sizes, and a few changes of single copies take up
what rounding left of each token total.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.runtime import stage

#: Records of one run of systematic rounding.
RUN = 100_000
#: Places at which the dual is evaluated in one pass.
POINTS = 9
#: Records of each mix, source and doubling of size that may take up the residue of rounding.
CANDIDATES = 6


def wanted_tokens(targets: list[dict], totals: dict[str, int]) -> list[dict]:
    """Token targets of each mix and source.

    The budget is a share of all records' tokens.  A source gives at most its
    tokens times its cap; what it can't give is shared among the others of the
    mix by their weights.  An absent source, or a weight that is null or not
    positive, gives nothing.
    """
    every, out = sum(totals.values()), []
    for mix in sorted({t["mix_id"] for t in targets}):
        rows = [dict(t, weight=max(0.0, t["target_share"] or 0.0)) for t in targets if t["mix_id"] == mix]
        total_weight = sum(r["weight"] for r in rows) or 1.0
        budget = max(0.0, max((r["budget_share"] or 0.0) for r in rows)) * every
        for r in rows:
            cap = r["max_repeats"]
            r["most"] = totals.get(r["source"], 0) * (math.inf if cap is None else max(0, cap)) if totals.get(r["source"], 0) else 0.0
            r["share"] = r["weight"] / total_weight
        open_rows, rest = [r for r in rows if r["weight"] > 0], budget
        for r in rows:
            r["wanted"] = 0.0
        while open_rows:
            weight = sum(r["weight"] for r in open_rows)
            full = [r for r in open_rows if rest * r["weight"] / weight >= r["most"]]
            if not full:
                for r in open_rows:
                    r["wanted"] = rest * r["weight"] / weight
                break
            for r in full:
                r["wanted"] = r["most"]
                rest -= r["most"]
            open_rows = [r for r in open_rows if r not in full]
        out.extend(rows)
    return out


def balance(histogram: DataFrame, rows: list[dict], means: dict[str, float], steps: int = 60, tolerance: float = 1e-6) -> dict[tuple, float]:
    """lambda of each (mix_id, source) by safeguarded Newton steps on the dual; histogram has source, tokens, n.

    Each step evaluates the dual's gradient at POINTS places at once, the Newton
    iterate and others that narrow the bracket, so few passes over the data are
    needed.
    """
    spark = histogram.sparkSession
    state = {(r["mix_id"], r["source"]): {"at": 0.0, "lo": None, "hi": None, "wanted": r["wanted"], "cap": r["max_repeats"], "done": not 0 < r["wanted"] < r["most"]} for r in rows}
    for _ in range(steps):
        todo = {k: s for k, s in state.items() if not s["done"]}
        if not todo:
            break
        asked = [(m, s, at, float(v["cap"]) if v["cap"] is not None else None, means[s]) for (m, s), v in todo.items() for at in _places(v)]
        now = spark.createDataFrame(asked, "mix_id long, source string, at double, cap double, mean double")
        x = F.col("tokens") / F.col("mean")
        tilt = F.exp(F.least(F.col("at") * x, F.lit(600.0)))
        free = F.col("cap").isNull() | (tilt < F.col("cap"))
        rate = F.when(free, tilt).otherwise(F.col("cap"))
        # the state is POINTS rows for each mix and source of the targets, a small fixed table
        sums = histogram.join(F.broadcast(now), "source").groupBy("mix_id", "source", "at").agg(F.sum(F.col("n") * F.col("tokens") * rate).alias("got"), F.sum(F.when(free, F.col("n") * F.col("tokens") * x * tilt).otherwise(0.0)).alias("slope"))
        met: dict[tuple, list] = {}
        for r in sums.collect():
            met.setdefault((r["mix_id"], r["source"]), []).append((r["at"], r["got"] - state[r["mix_id"], r["source"]]["wanted"], r["slope"]))
        for k, places in met.items():
            s = state[k]
            at, miss, slope = min(places, key=lambda p: (abs(p[1]), p[0]))
            s["at"] = at
            if abs(miss) <= tolerance * s["wanted"]:
                s["done"] = True
                continue
            below, above = [p[0] for p in places if p[1] < 0], [p[0] for p in places if p[1] > 0]
            s["lo"] = max(below + ([s["lo"]] if s["lo"] is not None else []), default=None)
            s["hi"] = min(above + ([s["hi"]] if s["hi"] is not None else []), default=None)
            s["newton"] = at - miss / slope if slope > 0 else math.nan
    return {k: s["at"] for k, s in state.items()}


def _places(s: dict) -> list[float]:
    """Where a source's dual is evaluated next."""
    lo, hi = s["lo"], s["hi"]
    if lo is None and hi is None:
        return [-16.0, -4.0, -1.0, -0.25, 0.0, 0.25, 1.0, 4.0, 16.0]
    if lo is None:
        return [hi - 2.0**j for j in range(POINTS)]
    if hi is None:
        return [lo + 2.0**j for j in range(POINTS)]
    places = [lo + (hi - lo) * (j + 1) / POINTS for j in range(POINTS - 1)]
    return [*places, s["newton"]] if lo < s["newton"] < hi else places


def listed_targets(targets: DataFrame) -> list[dict]:
    """The targets (a small fixed table); where a mix names a source twice, the greatest share holds, then the greatest cap and budget."""
    rows = [r.asDict() for r in targets.where("mix_id IS NOT NULL AND source IS NOT NULL").select("mix_id", "source", "target_share", "max_repeats", "budget_share").collect()]
    rank = lambda r: (r["target_share"] or 0.0, math.inf if r["max_repeats"] is None else r["max_repeats"], r["budget_share"] or 0.0)
    best: dict[tuple, dict] = {}
    for r in rows:
        k = r["mix_id"], r["source"]
        if k not in best or rank(r) > rank(best[k]):
            best[k] = r
    return [best[k] for k in sorted(best)]


def residue_changes(rounded: DataFrame, rows: list[dict]) -> list[tuple[int, int, int]]:
    """(mix_id, doc_id, change of copies) that bring the token totals next to what is wanted.

    Of each mix, source and doubling of size, at most CANDIDATES records that may
    have a copy more and as many that may have one less are looked at; the best
    single change is taken until none comes nearer.
    """
    slot = F.pmod(F.xxhash64("doc_id", "mix_id"), F.lit(CANDIDATES))
    rank = lambda allowed: F.min(F.when(allowed, F.struct(F.xxhash64("mix_id", "doc_id").alias("h"), "doc_id", "tokens")))
    more, less = F.col("cap").isNull() | (F.col("copies") + 1 <= F.col("cap")), F.col("copies") >= 1
    keys = ["mix_id", "source", F.floor(F.log2("tokens")).alias("doubling"), slot.alias("slot")]
    met = rounded.groupBy(*keys).agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), rank(more).alias("more"), rank(less).alias("less")).collect()
    wanted = {(r["mix_id"], r["source"]): r["wanted"] for r in rows}
    groups: dict[tuple, list] = {}
    for r in met:
        groups.setdefault((r["mix_id"], r["source"]), []).append(r)
    changes = []
    for key in sorted(groups):
        miss = wanted[key] - sum(r["got"] for r in groups[key])
        open_ = {(r[side]["doc_id"], sign): sign * r[side]["tokens"] for r in groups[key] for side, sign in (("more", 1), ("less", -1)) if r[side] is not None}
        used: set[int] = set()
        while True:
            left = [(abs(miss - delta), doc, sign, delta) for (doc, sign), delta in open_.items() if doc not in used]
            if not left or min(left)[0] >= abs(miss):
                break
            _, doc, sign, delta = min(left)
            used.add(doc)
            miss -= delta
            changes.append((key[0], doc, sign))
    return changes


def draw(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    """(mix_id, doc_id, source, tokens, copies of every drawn record; the targets with wanted tokens).

    ``sizes`` has doc_id, source, tokens.  Records without tokens or source are
    never drawn.  Rounding misses a token target by about a record for each run
    of RUN records; changes of single copies then take up that residue, until no
    change of a record looked at comes nearer.
    """
    records = sizes.where("tokens > 0 AND source IS NOT NULL").select("doc_id", "source", "tokens")
    listed = listed_targets(targets)
    named = sorted({t["source"] for t in listed})
    histogram = records.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    every = records.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    per = histogram.where(F.col("source").isin(named)).groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect()
    totals = {r["source"]: r["t"] for r in per}
    totals[None] = (every[0] or 0) - sum(totals.values())  # sources of no mix count for the budget
    rows = wanted_tokens(listed, totals)
    means = {r["source"]: r["t"] / r["n"] for r in per}
    at = balance(stage(histogram.where(F.col("source").isin(named))), rows, means)
    spark = sizes.sparkSession
    rates = spark.createDataFrame([(r["mix_id"], r["source"], at[r["mix_id"], r["source"]], None if r["max_repeats"] is None else float(r["max_repeats"]), r["wanted"] >= r["most"], means[r["source"]]) for r in rows if r["wanted"] > 0], "mix_id long, source string, at double, cap double, full boolean, mean double")
    rate = F.exp(F.col("at") * F.col("tokens") / F.col("mean"))
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.least(rate, F.coalesce("cap", rate)))
    runs = max(1, -(-(every[1] or 0) // RUN))
    drawn = records.join(F.broadcast(rates), "source").withColumn("rate", rate).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    order = Window.partitionBy("mix_id", "source", "run").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64("mix_id", "source", "run"), F.lit(1000)) / 1000
    drawn = drawn.withColumn("part", F.col("rate") - F.floor("rate")).withColumn("upto", F.sum("part").over(order) + offset)
    extra = F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("part") + 1e-9)
    copies = (F.floor("rate") + extra).cast("long")
    rounded = stage(drawn.select("mix_id", "doc_id", "source", "tokens", F.least(copies, F.coalesce(F.col("cap").cast("long"), copies)).alias("copies"), "cap"))
    # at most 2 CANDIDATES rows for each mix, source and doubling of size
    changes = spark.createDataFrame(residue_changes(rounded, rows), "mix_id long, doc_id long, change long")
    out = rounded.join(F.broadcast(changes), ["mix_id", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0).cast("long")))
    return out.select("mix_id", "doc_id", "source", "tokens", "copies").where("copies > 0"), rows


def shares(drawn: DataFrame, rows: list[dict]) -> DataFrame:
    """Target and actual share in tokens, tokens and most copies for each mix and source; absent sources with 0."""
    spark = drawn.sparkSession
    asked = spark.createDataFrame([(r["mix_id"], r["source"], float(r["share"]), float(r["wanted"]), r["max_repeats"]) for r in rows], "mix_id long, source string, target_share double, wanted_tokens double, max_repeats long")
    per = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("copies").alias("most_copies"))
    whole = Window.partitionBy("mix_id")
    return asked.join(per, ["mix_id", "source"], "left").na.fill(0, ["actual_tokens", "n_records", "most_copies"]).withColumn("actual_share", F.col("actual_tokens") / F.sum("actual_tokens").over(whole))
