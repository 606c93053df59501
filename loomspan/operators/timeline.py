"""Timelines of dated facts: contradictions, latest state, changes between facts, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import units
from loomspan.functions.units import haversine_km
from loomspan.runtime import stage

#: Column names of a fact: entity, predicate, precision, position, object, fact_id.
KEY = ["entity", "predicate"]
INSTANT = ["entity", "predicate", "precision", "position"]


def contradictions(facts: DataFrame) -> DataFrame:
    """Instants of one entity and predicate with more than one distinct object, compared as JSON text."""
    per = facts.groupBy(*INSTANT, F.to_json(F.struct("object")).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*INSTANT).agg(F.count(F.lit(1)).alias("n_objects"), F.sum("n").alias("n_facts")).where("n_objects > 1")


def instants(facts: DataFrame) -> DataFrame:
    """One row per instant: number of facts, and the fact itself where there is only one."""
    single = F.struct("fact_id", "object")
    per = facts.groupBy(*INSTANT).agg(F.count(F.lit(1)).alias("n_facts"), F.min(single).alias("_one"))
    return per.withColumn("only", F.when(F.col("n_facts") == 1, F.col("_one"))).drop("_one")


def with_previous(facts: DataFrame) -> DataFrame:
    """Single facts with the single fact of the instant before (``previous``).

    An instant of several facts is ambiguous: the next one has no previous fact.
    Facts are ordered by position, then precision.
    """
    order = Window.partitionBy(*KEY).orderBy("position", "precision")
    before = F.lag(F.struct("only", "position", "precision")).over(order)
    rows = instants(facts).withColumn("_b", before)
    return rows.where("n_facts = 1").select(
        *INSTANT, F.col("only.fact_id").alias("fact_id"), F.col("only.object").alias("object"),
        F.when(F.col("_b.only").isNotNull(), F.struct(F.col("_b.only.fact_id").alias("fact_id"), F.col("_b.only.object").alias("object"), F.col("_b.position").alias("position"), F.col("_b.precision").alias("precision"))).alias("previous"),
    )


def latest_state(facts: DataFrame) -> DataFrame:
    """The fact of the last instant of each entity and predicate, if it is the only one there."""
    last = instants(facts).groupBy(*KEY).agg(F.max_by(F.struct("n_facts", "only", "position", "precision"), F.struct("position", "precision")).alias("s"))
    return last.where("s.n_facts = 1").select(*KEY, "s.position", "s.precision", F.col("s.only.fact_id").alias("fact_id"), F.col("s.only.object").alias("object"))


def changes(facts: DataFrame) -> DataFrame:
    """Derived measures between a numeric fact and its previous one of the same precision.

    kind is interval_from_previous, absolute_change, percent_change (none from
    0) or annual_rate (none within no time); one row each.  Here percents are of
    the previous value's size and rates may be taken over days; :func:`derived`
    divides by the signed value and takes rates between years only.
    """
    rows = with_previous(facts).where("previous IS NOT NULL AND previous.precision = precision")
    new, old = F.col("object").cast("double"), F.col("previous.object").cast("double")
    days = (F.col("position") - F.col("previous.position")).cast("double")
    kind = lambda name, value, exact: F.struct(F.lit(name).alias("kind"), value.alias("value"), F.lit(exact).alias("exact"))
    derived = F.array(
        kind("interval_from_previous", days, True), kind("absolute_change", new - old, True), kind("percent_change", F.when(old != 0, (new - old) / F.abs(old) * 100), False),
        kind("annual_rate", F.when(days > 0, (new - old) / (days / 365.2425)), False),
    )
    out = rows.select(*INSTANT, "fact_id", F.col("previous.fact_id").alias("previous_id"), F.explode(derived).alias("d"))
    return out.select(*INSTANT, "fact_id", "previous_id", "d.kind", "d.value", "d.exact").where("value IS NOT NULL")


#: The formula of each derived measure.
FORMULAS = {
    "duration_years": "civil_year_ordinal(valid_to) - civil_year_ordinal(valid_from)", "duration_months": "civil_month_ordinal(valid_to) - civil_month_ordinal(valid_from)", "duration_days": "civil_day_ordinal(valid_to) - civil_day_ordinal(valid_from)",
    "temporal_midpoint": "(valid_from + valid_to) / 2", "age_at_start": "civil_ordinal(valid_from) - civil_ordinal(birth_year)", "normalized_measurement": "convert_to_canonical_unit(value, unit)",
    "interval_from_previous": "valid_from - previous.valid_from", "absolute_change": "current_canonical_value - previous_canonical_value", "percent_change": "(current - previous) / previous * 100",
    "annual_rate": "(current - previous) / elapsed_years", "distance_from_previous": "haversine(previous.coordinates, coordinates, earth_radius_km)",
}


def derived(facts: DataFrame) -> DataFrame:
    """All measures that can be worked out of dated facts: event_id, id, kind, value, unit, formula, dependencies, exact.

    ``facts`` has entity, predicate, precision (9, 10, 11), position (on the
    axis of the precision), year (ordinal), end_precision, end_position,
    birth_ordinal, value, unit, latitude, longitude and fact_id; what is null
    gives no measure.  Values are compared in canonical units; an instant of
    several facts has no successor.  A measure's id names its fact and kind.
    """
    unit_of = F.when(F.col("precision") == 9, "year").when(F.col("precision") == 10, "month").otherwise("day")
    measure = units.canonical(F.col("value"), F.col("unit"))
    rows = facts.withColumns({"_unit": unit_of, "_m": measure})
    state = F.struct("fact_id", "precision", "position", "_m", "latitude", "longitude")
    per = rows.groupBy(*INSTANT).agg(F.count(F.lit(1)).alias("_n"), F.min(state).alias("_s"))
    before = per.withColumn("_p", F.lag(F.when(F.col("_n") == 1, F.col("_s"))).over(Window.partitionBy(*KEY).orderBy("position", "precision"))).where("_n = 1").select("_p", F.col("_s.fact_id").alias("fact_id"))
    met = rows.join(before, "fact_id", "left")
    p, value, old = F.col("_p"), F.col("_m.value"), F.col("_p._m.value")
    same_axis, like = p["precision"] == F.col("precision"), (p["_m"]["dimension"] == F.col("_m.dimension")) & (p["_m"]["unit"] == F.col("_m.unit"))
    elapsed, length = (F.col("position") - p["position"]).cast("double"), (F.col("end_position") - F.col("position")).cast("double")
    ended, day, exact = F.col("end_precision") == F.col("precision"), F.col("precision") == 11, F.coalesce(F.col("_m.exact"), F.lit(False))
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & p["latitude"].isNotNull() & p["longitude"].isNotNull()
    age = F.col("year") - F.col("birth_ordinal")

    def one(kind, when, worth, unit, sure, both=False):
        found = F.when(when, worth.cast("double"))
        deps = F.array_compact(F.array(p["fact_id"], F.col("fact_id"))) if both else F.array("fact_id")
        return F.struct(F.lit(kind).alias("kind"), found.alias("value"), unit.alias("unit"), F.lit(FORMULAS[kind]).alias("formula"), deps.alias("dependencies"), sure.alias("exact"))

    unit, no, yes = F.col("_m.unit"), F.lit(False), F.lit(True)
    kinds = [one(f"duration_{u}s", ended & (F.col("_unit") == u), length, F.lit(u), day) for u in ("year", "month", "day")]
    kinds += [
        one("temporal_midpoint", ended, (F.col("position") + F.col("end_position")) / 2, F.concat(F.lit("civil_"), "_unit", F.lit("_ordinal")), day),
        one("age_at_start", age >= 0, age, F.lit("year"), no), one("normalized_measurement", F.col("_m").isNotNull(), value, unit, exact),
        one("interval_from_previous", same_axis, elapsed, F.col("_unit"), day, True), one("absolute_change", like, value - old, unit, exact & F.coalesce(p["_m"]["exact"], no), True),
        one("percent_change", like & (old != 0), (value - old) / F.when(old != 0, old) * 100, F.lit("%"), no, True),
        one("annual_rate", like & same_axis & (F.col("precision") == 9) & (elapsed != 0), (value - old) / F.when(elapsed != 0, elapsed), F.concat(unit, F.lit("/year")), no, True),
        one("distance_from_previous", known, haversine_km(p["latitude"], p["longitude"], F.col("latitude"), F.col("longitude")), F.lit("km"), no, True),
    ]
    out = met.select("fact_id", F.explode(F.array(*kinds)).alias("d")).where("d.value IS NOT NULL")
    return out.select(F.col("fact_id").alias("event_id"), F.concat(F.lit("calc:"), "fact_id", F.lit(":"), "d.kind").alias("id"), "d.*")


def distances(facts: DataFrame) -> DataFrame:
    """distance_from_previous: kilometres between a fact and its previous one, of any precision.

    ``object`` is a struct of latitude and longitude in degrees; a fact without
    either of them has no distance.
    """
    rows = with_previous(facts).where("previous IS NOT NULL")
    old, new = F.col("previous.object"), F.col("object")
    km = haversine_km(old["latitude"], old["longitude"], new["latitude"], new["longitude"])
    # least() skips nulls, so a missing coordinate would give half the equator
    known = old["latitude"].isNotNull() & old["longitude"].isNotNull() & new["latitude"].isNotNull() & new["longitude"].isNotNull()
    out = rows.select(*INSTANT, "fact_id", F.col("previous.fact_id").alias("previous_id"), F.lit("distance_from_previous").alias("kind"), F.when(known, km).alias("value"), F.lit(False).alias("exact"))
    return out.where("value IS NOT NULL")


def durations(spans: DataFrame, start: Column, end: Column, precision: Column) -> DataFrame:
    """Length and midpoint of spans whose bounds have one precision (9 year, 10 month, 11 day), on the axis of that precision.

    ``start`` and ``end`` are positions: years, months or days in a row.
    """
    kind = F.when(precision == 9, "duration_years").when(precision == 10, "duration_months").otherwise("duration_days")
    length = (end - start).cast("double")
    middle = (start + end) / 2
    rows = spans.withColumns({"_k": kind, "_l": length, "_m": middle, "_p": precision}).where("_l >= 0")
    parts = F.array(F.struct(F.col("_k").alias("kind"), F.col("_l").alias("value")), F.struct(F.lit("temporal_midpoint").alias("kind"), F.col("_m").alias("value")))
    return rows.withColumn("d", F.explode(parts)).withColumns({"kind": F.col("d.kind"), "value": F.col("d.value"), "exact": F.col("_p") == 11}).drop("d", "_k", "_l", "_m", "_p")


def effective(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts left after corrections; edges has fact_id, target_id, kind (``retracts`` or ``supersedes``).

    A retraction removes its target anywhere, a supersession only a target of
    the same instant.
    """
    where = facts.select("fact_id", F.struct(*INSTANT).alias("at"))
    retracted = edges.where("kind = 'retracts'").join(facts.select("fact_id"), "fact_id", "left_semi").select(F.col("target_id").alias("fact_id"))
    sup = edges.where("kind = 'supersedes'").join(where, "fact_id").withColumnRenamed("at", "own").select("own", F.col("target_id").alias("fact_id")).join(where, "fact_id").where("own = at").select("fact_id")
    return facts.join(retracted.unionByName(sup).distinct(), "fact_id", "left_anti")


def correction_problems(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """fact_id, target_id, problem: unknown_target, self, other_key (supersession across keys) or cycle."""
    keys = facts.select("fact_id", F.struct(*KEY).alias("key"))
    unknown = edges.join(keys.select(F.col("fact_id").alias("target_id")), "target_id", "left_anti").select("fact_id", "target_id", F.lit("unknown_target").alias("problem"))
    own = edges.where("fact_id = target_id").select("fact_id", "target_id", F.lit("self").alias("problem"))
    pair = edges.where("kind = 'supersedes'").join(keys, "fact_id").withColumnRenamed("key", "own").join(keys.withColumnsRenamed({"fact_id": "target_id"}), "target_id")
    across = pair.where("own <> key").select("fact_id", "target_id", F.lit("other_key").alias("problem"))
    loops = on_cycles(edges.where("fact_id <> target_id").select(F.col("fact_id").alias("src"), F.col("target_id").alias("dst")))
    cycle = loops.select(F.col("node").alias("fact_id"), F.lit(None).cast(edges.schema["target_id"].dataType).alias("target_id"), F.lit("cycle").alias("problem"))
    return unknown.unionByName(own).unionByName(across).unionByName(cycle)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle, of any length, with the length of the shortest one.

    Nodes without an edge in and one out are peeled off until none is left.  Each
    node left is then searched from both sides: what it reaches in a steps and
    what reaches it in b steps, at exactly these distances, meet first at a + b =
    the length of its shortest cycle.  The sides take turns, so neither goes
    further than half of a cycle; a node that is found, or has a side without
    anything new, is done.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    edges = stage(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct())
    n_edges = edges.count()
    while n_edges:
        kept = edges
        for _ in range(3):
            kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        kept = stage(kept)
        before, n_edges, edges = n_edges, kept.count(), kept
        if n_edges == before:
            break
    ways = [("src", "dst"), ("dst", "src")]
    steps = [edges.select(F.col(a).alias("at"), F.col(b).alias("next")) for a, b in ways]
    found = [stage(edges.where("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("length")))]
    sides = [stage(edges.select(F.col(a).alias("node"), F.col(b).alias("at")).join(found[0], "node", "left_anti")) for a, b in ways]
    met = [[side] for side in sides]
    length = 2
    while True:
        found = _few([*found, stage(sides[0].join(sides[1], ["node", "at"], "left_semi").select("node").distinct().withColumn("length", F.lit(length)))])
        length += 1
        turn = (length + 1) % 2
        going = sides[turn].join(sides[1 - turn].select("node").distinct(), "node", "left_semi")
        for old in found:
            going = going.join(old, "node", "left_anti")
        walk = going.join(steps[turn], "at").select("node", F.col("next").alias("at")).distinct()
        for old in met[turn]:
            walk = walk.join(old, ["node", "at"], "left_anti")
        sides[turn] = stage(walk)
        if not sides[turn].take(1):
            break
        met[turn] = _few([*met[turn], sides[turn]])
    return reduce(DataFrame.unionByName, found)


def _few(tables: list[DataFrame]) -> list[DataFrame]:
    """The same rows in at most eight tables, so that plans stay small however many steps there are."""
    return tables if len(tables) <= 8 else [stage(reduce(DataFrame.unionByName, tables))]


def two_hops(facts: DataFrame) -> DataFrame:
    """Pairs of facts where the first one's object is the second one's entity, not leading back."""
    a = facts.select(F.col("fact_id").alias("first_id"), F.col("entity").alias("start"), F.col("object").alias("mid"))
    b = facts.select(F.col("fact_id").alias("second_id"), F.col("entity").alias("mid"), F.col("object").alias("end"))
    return a.join(b, "mid").where("first_id <> second_id AND end <> start")
