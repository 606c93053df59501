"""Event memory: ordered concept occurrences, sequence patterns with lineage, recall and prediction."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import concept_keys, canonical_value, json_entries, normalise_token_text, token_list
from loomspan.operators import blocks
from loomspan.runtime import stage

# Fixed values of the model.
TRUSTED = ("observed", "executed", "user_confirmed")
MAX_ORDER = 3
MATCH_EVENTS, RECALL_EVENTS, NEIGHBOURS = 6, 12, 1
EVIDENCE, PATH = 25, 100
#: Characters of an event's text that a recalled episode shows.
EXCERPT = 4_000
#: Events of one episode per window; longer episodes are cut into blocks that are stitched at their edges.
BLOCK = 100_000


def event_log(rows: DataFrame) -> DataFrame:
    """memory_events without redeliveries: the first row of each idempotency key (or id, where the key is blank).

    Adds ``episode`` (the event's own id where none is given) and ``trusted``;
    without a column context_json all contexts are unknown.  Events without any token are left out, as nothing can be learnt from them.
    """
    key = F.coalesce(F.nullif(F.trim("idempotency_key"), F.lit("")), F.col("id"))
    first = rows.groupBy(key.alias("_key")).agg(F.min("ingest_order").alias("ingest_order"))
    kept = rows.join(first.select("ingest_order"), "ingest_order", "left_semi")
    context = F.col("context_json") if "context_json" in rows.columns else F.lit(None).cast("string")
    return kept.select(
        "ingest_order", "id", F.coalesce(F.nullif(F.trim("episode_id"), F.lit("")), F.col("id")).alias("episode"), "text", "source_type",
        F.col("source_type").isin(*TRUSTED).alias("trusted"), "context_signature", context.alias("context_json"), "created_at", concept_keys(F.col("text")).alias("tokens"),
    ).where("size(tokens) > 0")


def key_conflicts(rows: DataFrame) -> DataFrame:
    """Idempotency keys that return with another text or source: n deliveries and n contents."""
    key = F.nullif(F.trim("idempotency_key"), F.lit(""))
    content = F.sha2(F.concat_ws("\u0001", F.col("text"), F.col("source_type"), F.coalesce("episode_id", F.lit(""))), 256)
    per = rows.select(key.alias("key"), content.alias("c")).where("key IS NOT NULL").groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("n_deliveries"), F.count(F.lit(1)).alias("n_contents")).withColumn("conflict", F.col("n_contents") > 1)


def occurrences(log: DataFrame) -> DataFrame:
    """One row for each token of each event: ordinal from 0 within the event."""
    return log.select("ingest_order", "id", "episode", "trusted", "context_signature", "created_at", F.posexplode("tokens").alias("ordinal", "token"))


def with_history(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events with ``carry``: the up to three tokens before the event in its trusted segment.

    An untrusted event bounds a segment.  Every event has a token, so the three
    events before suffice.  Blocks of an episode run apart; the first and last
    three events of each block run again together, so that no window holds more
    than a block or the edges of an episode's blocks.
    """
    slim = log.withColumn("_block", F.floor(F.col("ingest_order") / block)).withColumn("_tail", F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - (MAX_ORDER - 1)), F.lit(MAX_ORDER)))
    own = Window.partitionBy("episode", "_block")
    up = own.orderBy("ingest_order")

    def lags(df: DataFrame, w) -> DataFrame:
        state = F.struct("trusted", "_tail")
        return df.withColumns({f"_l{i}": F.lag(state, i).over(w) for i in range(1, MAX_ORDER + 1)})

    marked = lags(slim, up).withColumn("_rn", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(own))
    inner = marked.where(f"_rn > {MAX_ORDER}")
    edge = marked.where(f"_rn <= {MAX_ORDER} OR _rn > _n - {MAX_ORDER}")
    edge = lags(edge, Window.partitionBy("episode").orderBy("ingest_order")).where(f"_rn <= {MAX_ORDER}")
    both = inner.unionByName(edge)
    empty = F.array().cast("array<string>")
    carry = empty
    for i in range(MAX_ORDER, 0, -1):
        before = F.col(f"_l{i}")
        carry = F.when(before.isNull(), carry).when(before["trusted"], F.concat(carry, before["_tail"])).otherwise(empty)
    carry = F.when(F.size(carry) > MAX_ORDER, F.slice(carry, -MAX_ORDER, MAX_ORDER)).otherwise(carry)
    return both.withColumn("carry", carry).drop("_block", "_tail", "_rn", "_n", *(f"_l{i}" for i in range(1, MAX_ORDER + 1)))


def evidence_spans(log: DataFrame, last: str | None = None) -> DataFrame:
    """Every pattern of one to three tokens with the token that follows it: the lineage of the model.

    Only trusted events teach; context and time are those of the following
    token's event.  pattern is the tokens joined by blanks.  With ``last`` only
    patterns that end in that token are made: places are picked out of the
    arrays before anything is multiplied.
    """
    events = with_history(log).where("trusted").withColumn("_all", F.concat("carry", "tokens")).withColumn("_off", F.size("carry"))
    places = F.sequence(F.lit(1), F.size("tokens"))
    if last is not None:
        events = events.where(F.array_contains("_all", last))
        places = F.filter(places, lambda i: F.try_element_at("_all", F.when(F.col("_off") + i > 1, F.col("_off") + i - 1)) == last)
    rows = events.select("episode", "id", "ingest_order", "context_signature", "context_json", "created_at", "_all", "_off", F.explode(places).alias("_i"))
    place = F.col("_off") + F.col("_i")
    rows = rows.withColumn("_place", place).where("_place > 1").withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_ORDER), F.col("_place") - 1))))
    return rows.select(
        "length", F.array_join(F.slice("_all", F.col("_place") - F.col("length"), F.col("length")), " ").alias("pattern"), F.element_at("_all", F.col("_place")).alias("next_token"),
        "context_signature", "context_json", "episode", "id", "ingest_order", (F.col("_i") - 1).alias("ordinal"), "created_at",
    )


def continuations(spans: DataFrame) -> DataFrame:
    """Support, distinct episodes, first and last time of each pattern, context and following token."""
    keys = ["length", "pattern", "context_signature", "next_token"]
    per = spans.groupBy(*keys, "episode").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("episode_support"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    return out.withColumn("decayed_support", F.col("support").cast("double"))


def decayed_support(spans: DataFrame, as_of: str, half_life_days: float) -> DataFrame:
    """Extension: support that halves with age, at an explicit time."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400.0
    return spans.groupBy("length", "pattern", "next_token").agg(F.sum(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life_days)).alias("decayed_support"))


def recency(moment: Column, as_of: str) -> Column:
    """1 / (1 + age in days / 30); never above 1."""
    age = (F.lit(as_of).cast("timestamp").cast("double") - moment.cast("timestamp").cast("double")) / 86400.0
    return 1.0 / (1.0 + F.greatest(age, F.lit(0.0)) / 30.0)


def context_match(pattern: Column, wanted: Column) -> Column:
    """Likeness of two contexts (map<string,string> of canonical JSON); null wanted gives 0.

    An empty wanted context matches only the empty one, an empty pattern counts
    a quarter, else the Jaccard similarity of the entries.
    """
    a, b = F.map_entries(pattern), F.map_entries(wanted)
    union = F.size(F.array_union(a, b))
    return (
        F.when(wanted.isNull(), F.lit(0.0))
        .when(F.size(wanted) == 0, F.when(F.size(pattern) == 0, 1.0).otherwise(0.0))
        .when(F.size(pattern) == 0, F.lit(0.25))
        .otherwise(F.size(F.array_intersect(a, b)) / union)
    )


def prepared_query(history) -> tuple[list[str], dict | None]:
    """(normalised tokens, wanted context) of a history or query: a text, a list of texts and values, or a mapping of either.

    A mapping has the tokens under ``history``, ``text`` or ``items`` and the
    context under ``context``; a null history has no tokens.  Raises TypeError
    for anything else.
    """
    context = None
    if isinstance(history, Mapping):
        context = history.get("context")
        if context is not None and not isinstance(context, Mapping):
            raise TypeError("context must be a mapping")
        history = next((history[k] for k in ("history", "text", "items") if k in history), [])
    if history is None:
        return [], context
    if isinstance(history, str):
        return token_list(history), context
    if not isinstance(history, Iterable):
        raise TypeError("history must be a text, a sequence or a mapping")
    tokens: list[str] = []
    for item in history:
        text = item if isinstance(item, str) else str(item)
        found = (token_list(text) if isinstance(item, str) else []) or [normalise_token_text(text.strip())]
        tokens.extend(t for t in found if t)
    return tokens, context


def wanted_context(context: Mapping | None) -> Column:
    """A wanted context as a map of name to canonical JSON; null for none."""
    if context is None:
        return F.lit(None).cast("map<string,string>")
    pairs = [F.lit(x) for k, v in context.items() for x in (str(k), canonical_value(v))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def predict(spans: DataFrame, history: list[str], top_k: int, as_of: str, context: Mapping | None = None) -> DataFrame:
    """The tokens that follow the longest known suffix of ``history`` (normalised tokens), ranked.

    score = 2 ln(1+support) + ln(1+episodes) + 0.75 suffix length + context + recency.
    The context is the best likeness (:func:`context_match`) of any pattern's
    context to the wanted one.  Ties fall to the greater support, then the
    greater token.  An empty or unknown history gives no rows.
    """
    suffixes = [(n, " ".join(history[-n:])) for n in range(1, min(MAX_ORDER, len(history)) + 1)]
    wanted = F.lit(False)
    for n, pattern in suffixes:
        wanted = wanted | (F.col("length") == n) & (F.col("pattern") == pattern)
    likeness = F.lit(0.0) if context is None else context_match(json_entries(F.col("context_json")), wanted_context(context))
    # the rows of at most three patterns, read again for the longest of them
    hits = stage(spans.where(wanted).select("length", "next_token", "episode", "created_at", "context_signature", likeness.alias("likeness")))
    longest = hits.agg(F.max("length")).first()[0]
    hits = hits.where(F.col("length") == F.lit(longest).cast("int"))
    per = hits.groupBy("length", "next_token", "episode", "context_signature").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"), F.max("likeness").alias("likeness"))
    merged = per.groupBy("length", "next_token").agg(
        F.sum("n").alias("support"), F.countDistinct("episode").alias("episodes"), F.max("last").alias("last_seen"), F.max("likeness").alias("context_match"), F.countDistinct("context_signature").alias("n_contexts"),
    )
    score = 2 * F.log1p("support") + F.log1p("episodes") + 0.75 * F.col("length") + F.col("context_match") + recency(F.col("last_seen"), as_of)
    top = merged.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc("support"), F.desc("next_token")).limit(top_k)
    return top.withColumn("ranking_share", F.round(F.col("score") / F.sum("score").over(Window.partitionBy(F.lit(1))), 6))


def lineage(spans: DataFrame, pattern: str, next_token: str, limit: int = EVIDENCE) -> DataFrame:
    """The newest evidence of one continuation."""
    return spans.where((F.col("pattern") == pattern) & (F.col("next_token") == next_token)).orderBy(F.desc("ingest_order"), F.desc("ordinal")).limit(limit)


def recall(log: DataFrame, query: list[str], top_k: int, as_of: str, context: Mapping | None = None) -> DataFrame:
    """Episodes ranked for a query of normalised tokens.

    Candidates are the 4k episodes with most distinct matches, occurrences and
    the latest match.  In each the six events with most matches (newest first)
    and their neighbours make the context, twelve events at most; matches are
    counted there.  context_match is the likeness of the context of an episode's
    first event to the wanted one; path has the first tokens of the events, text
    their beginnings.  An empty query gives the newest episodes; unknown tokens
    still count for coverage.

    The log is read three times (matches; candidates' neighbours; chosen
    events); between the passes the driver holds at most 4k episodes, six seeds
    and twelve events of each.
    """
    spark, query = log.sparkSession, list(dict.fromkeys(query))
    if not query:
        newest = log.groupBy("episode").agg(F.max("created_at").alias("updated_at")).orderBy(F.desc("updated_at"), "episode").limit(top_k)
        return newest.select("episode", F.lit(0).alias("matched"), F.lit(0).alias("n_occurrences"), F.round(recency(F.col("updated_at"), as_of), 6).alias("score"))
    terms = F.array(*map(F.lit, query))
    hits = F.filter("tokens", lambda t: F.array_contains(terms, t))
    matches = stage(log.select("episode", "ingest_order", "created_at", hits.alias("hits")).where("size(hits) > 0"))
    per_token = matches.select("episode", "created_at", F.explode("hits").alias("token")).groupBy("episode", "token").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))
    ranked = per_token.groupBy("episode").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("o"), F.max("latest").alias("latest")).orderBy(F.desc("m"), F.desc("o"), F.desc("latest"), "episode").limit(4 * top_k)
    candidates = [r[0] for r in ranked.select("episode").collect()]
    best = Window.partitionBy("episode").orderBy(F.desc(F.size(F.array_distinct("hits"))), F.desc("ingest_order"))
    seeds: dict[str, list[int]] = {}
    for r in matches.where(F.col("episode").isin(candidates)).withColumn("_rn", F.row_number().over(best)).where(f"_rn <= {MATCH_EVENTS}").select("episode", "ingest_order").collect():
        seeds.setdefault(r["episode"], []).append(r["ingest_order"])
    # for each seed the nearest event before and after, the episode's times and first context, in one aggregation
    named = spark.createDataFrame(list(seeds.items()), "episode string, seeds array<long>")
    near = log.where(F.col("episode").isin(candidates)).select("episode", "ingest_order", "created_at", "context_json").join(F.broadcast(named), "episode")
    before, after = F.array_max(F.filter("seeds", lambda s: s < F.col("ingest_order"))), F.array_min(F.filter("seeds", lambda s: s > F.col("ingest_order")))
    roles = F.array(F.struct(F.lit("whole").alias("role"), F.lit(None).cast("long").alias("seed")), F.struct(F.lit("after").alias("role"), before.alias("seed")), F.struct(F.lit("before").alias("role"), after.alias("seed")))
    told = near.withColumn("r", F.explode(F.filter(roles, lambda x: (x["role"] == "whole") | x["seed"].isNotNull())))
    facts = told.groupBy("episode", F.col("r.role").alias("role"), F.col("r.seed").alias("seed")).agg(
        F.min("ingest_order").alias("least"), F.max("ingest_order").alias("most"), F.max(F.when(F.col("r.role") == "whole", F.col("created_at"))).alias("updated_at"),
        F.min_by(F.when(F.col("r.role") == "whole", F.col("context_json")), "ingest_order").alias("context_json"),
    ).collect()
    priority = {(e, i): 0 for e, own in seeds.items() for i in own}
    updated = []
    for r in facts:
        if r["role"] == "whole":
            updated.append((r["episode"], r["updated_at"], r["context_json"]))
        else:
            priority.setdefault((r["episode"], r["least"] if r["role"] == "after" else r["most"]), 1)
    chosen: dict[str, list[int]] = {}
    for episode, i in sorted(priority, key=lambda x: (priority[x], -x[1])):
        if len(chosen.setdefault(episode, [])) < RECALL_EVENTS:
            chosen[episode].append(i)
    picked = [i for own in chosen.values() for i in own]
    rows = log.where(F.col("ingest_order").isin(picked)).select("episode", "ingest_order", "tokens", "text", hits.alias("hits"))
    scored = rows.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.size("hits")).alias("n_occurrences"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("matched"),
        F.array_sort(F.collect_list(F.struct("ingest_order", F.slice("tokens", 1, PATH).alias("t"), F.when(F.length("text") > EXCERPT, F.concat(F.substring("text", 1, EXCERPT - 1), F.lit("…"))).otherwise(F.col("text")).alias("x")))).alias("e"),
    )
    scored = scored.join(F.broadcast(spark.createDataFrame(updated, f"episode string, updated_at {log.schema['created_at'].dataType.simpleString()}, context_json string")), "episode")
    likeness = F.lit(0.0) if context is None else context_match(json_entries(F.col("context_json")), wanted_context(context))
    score = 2.0 * F.col("matched") + 2.0 * F.col("matched") / len(query) + F.log1p("n_occurrences") + likeness + recency(F.col("updated_at"), as_of)
    path = F.array_join(F.slice(F.flatten(F.transform("e", lambda x: x["t"])), 1, PATH), " ")
    out = scored.withColumn("context_match", F.round(likeness, 6)).withColumn("score", F.round(score, 6)).withColumns({"path": path, "text": F.array_join(F.transform("e", lambda x: x["x"]), "\n")})
    return out.orderBy(F.desc("score"), F.desc(F.least("n_occurrences", F.lit(EVIDENCE))), F.desc("episode")).limit(top_k).select("episode", "matched", "n_occurrences", "n_events", "context_match", "score", "path", "text")


def token_paths(log: DataFrame, most: int = PATH) -> DataFrame:
    """The first tokens of each episode in order, joined by blanks, and whether there are more."""
    # every event has a token, so the first most + 1 events suffice; Spark cuts them off before the shuffle
    order = Window.partitionBy("episode").orderBy("ingest_order")
    first = log.select("episode", "ingest_order", "tokens").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most + 1)
    upto = F.sum(F.size("tokens")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("_before", F.coalesce(upto, F.lit(0))).where(f"_before <= {most}")
    items = first.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("ingest_order", "tokens"))).alias("s"))
    path = F.flatten(F.transform("s", lambda x: x["tokens"]))
    return items.select("episode", F.array_join(F.slice(path, 1, most), " ").alias("path"), (F.size(path) > most).alias("truncated"))


def forget(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without the events of ``tombstones`` (column id).

    An episode splits at each deleted event, so that no adjacency bridges the
    hole: what lies after the last hole keeps the episode's id, older parts get
    an id of their own.  Deletions are summed by blocks, so an episode of any
    size splits; occurrences, spans and continuations are derived from the log
    and go with their events.
    """
    gone = tombstones.select("id").distinct().withColumn("_gone", F.lit(1))
    marked = log.join(gone, "id", "left").na.fill(0, ["_gone"])
    after = blocks.running(marked, ["episode"], [F.desc("ingest_order")], {"_part": F.col("_gone")})
    kept = after.where("_gone = 0")
    return kept.withColumn("episode", F.when(F.col("_part") == 0, F.col("episode")).otherwise(F.concat("episode", F.lit("/"), F.col("_part").cast("string")))).drop("_gone", "_part")


def event_ids(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, id: the event that holds each key of ``keys`` (column key); blank and unknown keys give no row.

    Of redelivered rows the first one holds the key.
    """
    trimmed = F.nullif(F.trim("idempotency_key"), F.lit(""))
    asked = keys.select(F.trim("key").alias("key")).where("key <> ''").distinct()
    held = rows.select(trimmed.alias("key"), "ingest_order", "id").where("key IS NOT NULL").groupBy("key").agg(F.min_by("id", "ingest_order").alias("id"))
    return held.join(asked, "key", "left_semi")


def events_exist(log: DataFrame, ids: DataFrame) -> DataFrame:
    """id, exists for each id asked for (column id); a blank id doesn't exist."""
    asked = ids.select(F.trim("id").alias("id")).where("id IS NOT NULL").distinct()
    return asked.join(log.select("id", F.lit(True).alias("exists")).distinct(), "id", "left").na.fill(False, ["exists"])


def forget_by_key(rows: DataFrame, log: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the log without the events of the keys; key, id, forgotten of each key): deleting again changes nothing."""
    asked = keys.select(F.trim("key").alias("key")).where("key <> ''").distinct()
    found = event_ids(rows, keys)
    there = found.join(log.select("id"), "id", "left_semi")
    outcome = asked.join(there, "key", "left").select("key", "id", F.col("id").isNotNull().alias("forgotten"))
    return forget(log, there.select("id")), outcome


def cascade(log: DataFrame, concepts: DataFrame) -> DataFrame:
    """What hangs on the events that are left: events, episodes, occurrences, spans, continuations, and concepts that nothing uses any more.

    ``concepts`` has canonical_key.  Nothing but the log is stored, so deleting
    from it deletes everything derived; the counts show it.
    """
    spans = evidence_spans(log)
    used = log.select(F.explode("tokens").alias("canonical_key")).distinct()
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    parts = [("events", log.select("id")), ("episodes", log.select("episode").distinct()), ("spans", spans.select("length")), ("continuations", continuations(spans).select("pattern")), ("unused_concepts", concepts.select("canonical_key").distinct().join(used, "canonical_key", "left_anti"))]
    out = one("occurrences", log.select(F.explode("tokens")))
    for name, df in parts:
        out = out.unionByName(one(name, df))
    return out


def stats(log: DataFrame) -> DataFrame:
    """Counters of the memory as rows: events, trusted events, occurrences, episodes, concepts and events by source.

    Two passes: sums by source with their total, and one distinct count of
    episodes and concepts together.  An empty log has zeros.
    """
    sums = log.rollup("source_type").agg(F.grouping("source_type").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.col("trusted").cast("long")).alias("t"), F.sum(F.size("tokens").cast("long")).alias("o"))
    pair = lambda name, n: F.struct(name.alias("counter"), n.cast("long").alias("n"))
    told = F.when(F.col("total") == 1, F.array(pair(F.lit("events"), F.col("n")), pair(F.lit("trusted_events"), F.col("t")), pair(F.lit("occurrences"), F.col("o")))).otherwise(F.array(pair(F.concat(F.lit("events from "), "source_type"), F.col("n"))))
    thing = lambda name, value: F.struct(F.lit(name).alias("counter"), value.alias("v"))
    things = log.select(F.explode(F.concat(F.array(thing("episodes", F.col("episode"))), F.transform("tokens", lambda t: thing("concepts", t)))).alias("x")).select("x.*").distinct()
    zeros = log.sparkSession.createDataFrame([(c, 0) for c in ("events", "trusted_events", "occurrences", "episodes", "concepts")], "counter string, n long")
    rows = sums.select(F.inline(told)).unionByName(things.groupBy("counter").agg(F.count(F.lit(1)).alias("n"))).unionByName(zeros)
    return rows.groupBy("counter").agg(F.sum("n").alias("n"))
