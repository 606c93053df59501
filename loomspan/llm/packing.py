"""Texts into containers of fixed capacity: vector bin packing by dot products.

A container limits three things at once: tokens (a separator is spent between
two items), the number of segments and the loss-bearing tokens.  Items go, as
they are, into groups by hash; a group is packed one container at a time with
the fitting item whose size vector (tokens, loss-bearing tokens, one segment, as
shares of the limits) has the largest dot product with what is left, over a root
of the vector's length: every item takes one segment, so without the root only
its size would tell items apart and the small ones would be left to the end.
Only a text larger than the capacity is split, into pieces that fill containers
and one rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group.  Each group leaves at most about one container half empty.
GROUP_ITEMS = 20_000
#: Most loss-bearing tokens of a container as a share of its tokens, and most segments as a multiple of what the corpus fills a container with.
LOSS_SHARE, SEGMENT_MULTIPLE = 0.95, 8
#: Power of an item's length by which its dot product is divided.
ROOT = 0.25
LIMITS = ("tokens", "loss", "segments", "end")


def pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec columns with doc_id, piece, token_from, tokens, loss_tokens: texts split where they exceed the capacity.

    Texts without tokens take no room and are left out; a capacity that is null
    or below 1 gives no rows.
    """
    specs = specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"))
    # the specifications are a small fixed table; every text is meant for each of them
    rows = [F.struct(*(F.lit(v).cast("long").alias(k) for k, v in r.asDict().items())) for r in specs.collect()]
    none = F.array().cast("array<struct<spec_id:bigint,capacity_tokens:bigint,separator_tokens:bigint>>")
    each = sizes.where("tokens > 0").withColumn("spec", F.explode(F.array(*rows) if rows else none))
    each = each.select("spec.*", "doc_id", F.col("tokens").alias("all_tokens"), "loss_tokens")
    count = F.ceil(F.col("all_tokens") / F.col("capacity_tokens"))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("piece") * F.col("capacity_tokens")
    tokens = F.least(F.col("capacity_tokens"), F.col("all_tokens") - start)
    loss = F.greatest(F.lit(0), F.least(tokens, start + tokens - (F.col("all_tokens") - F.col("loss_tokens"))))
    return each.select("spec_id", "capacity_tokens", "separator_tokens", "doc_id", "piece", start.alias("token_from"), tokens.alias("tokens"), loss.cast("long").alias("loss_tokens"))


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, separator: int, segments: int, most_loss: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Container and place in it of each item, and the limit that closed each container; every single item must fit an empty one.

    The limit is a place in LIMITS: loss if an item would still have fitted by
    its tokens, segments if one would have fitted but for the number of
    segments, end for the last container.
    """
    kinds, kind_of = np.unique(np.column_stack((tokens, loss)), axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    following = np.concatenate(([0], np.cumsum(left)))[:-1]
    # equal items are one kind, kinds stand in order of tokens: a step looks at the kinds that still fit
    container, place, closed = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64), []
    size, lossy, alive = (kinds[:, 0] + separator).astype(float), kinds[:, 1].astype(float), np.arange(len(kinds))
    most = capacity + separator, most_loss

    def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = size / most[0], lossy / most[1]
        root = np.sqrt(a * a + b * b + 1 / segments**2) ** ROOT
        return a / root, b / root, 1 / (segments * root)

    of_size, of_loss, of_seat = weights()
    room, lossroom, seats, held, dead = float(most[0]), float(most[1]), segments, 0, 0
    packed = 0
    while packed < len(tokens):
        upto = np.searchsorted(size, room, side="right")
        best = -1
        if upto:
            value = of_size[:upto] * (room / most[0]) + of_loss[:upto] * (lossroom / most[1]) + of_seat[:upto] * (seats / segments)
            there = left[alive[:upto]] > 0
            value[~there | (lossy[:upto] > lossroom)] = -1.0
            best = int(value.argmax())
            if value[best] < 0 or not seats:
                closed.append(2 if value[best] >= 0 else 1 if there.any() else 0)
                best = -1
        else:
            closed.append(0)
        if best < 0:
            room, lossroom, seats, held = float(most[0]), float(most[1]), segments, 0
            continue
        kind = alive[best]
        item = order[following[kind]]
        following[kind] += 1
        left[kind] -= 1
        container[item], place[item] = len(closed), held
        packed += 1
        room, lossroom, seats, held = room - size[best], lossroom - lossy[best], seats - 1, held + 1
        if not left[kind]:
            dead += 1
            if dead * 4 > len(alive):
                keep = left[alive] > 0
                size, lossy, alive, dead = size[keep], lossy[keep], alive[keep], 0
                of_size, of_loss, of_seat = weights()
    return container, place, [*closed, 3]


def limits(items: DataFrame, max_segments: int | None = None, loss_share: float = LOSS_SHARE) -> dict[int, tuple[int, int]]:
    """(most segments, most loss-bearing tokens) of a container of each specification.

    Segments: SEGMENT_MULTIPLE times what a full container of the corpus' own
    texts would hold on average, and at most one for 16 tokens.
    """
    whole = items.where("tokens < capacity_tokens").groupBy("spec_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = items.groupBy("spec_id").agg(F.first("capacity_tokens").alias("c")).join(whole, "spec_id", "left").collect()  # a row for each specification
    return {r["spec_id"]: (max_segments or max(1, min(r["c"] // 16, -(-SEGMENT_MULTIPLE * r["c"] * r["n"] // r["t"]) if r["t"] else 1)), max(1, int(r["c"] * loss_share))) for r in rows}


def containers(sizes: DataFrame, specs: DataFrame, max_segments: int | None = None, loss_share: float = LOSS_SHARE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """spec_id, container, place, doc_id, piece, token_from, tokens, closed_by of every text in every specification.

    ``max_segments``: most items of a container, by default as :func:`limits`
    has it.  ``loss_share``: most loss-bearing tokens as a share of its tokens;
    an item that has more itself fills that limit alone.
    """
    items = pieces(sizes, specs)
    groups = max(1, -(-sizes.count() // group_items))
    most = limits(items, max_segments, loss_share)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, separator = int(pdf.capacity_tokens.iloc[0]), int(pdf.separator_tokens.iloc[0])
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        segments, most_loss = most[int(key[0])]
        loss = np.minimum(pdf.loss_tokens.to_numpy(), most_loss)
        number, place, closed = pack(pdf.tokens.to_numpy(), loss, capacity, separator, segments, most_loss)
        by = np.array(LIMITS, dtype=object)[np.array(closed)[number]]
        return pdf.assign(container=number * groups + int(key[1]), place=place, closed_by=by)[["spec_id", "container", "place", "doc_id", "piece", "token_from", "tokens", "closed_by"]]

    return items.groupBy("spec_id", "bucket").applyInPandas(one, "spec_id long, container long, place long, doc_id long, piece long, token_from long, tokens long, closed_by string")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, items, tokens, the share of capacity that tokens and separators use, and how many containers each limit closed, for each specification."""
    closed = [F.sum((F.col("closed_by") == x).cast("long")).alias(f"closed_by_{x}") for x in LIMITS]
    per = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.first("closed_by").alias("closed_by"))
    per = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("tokens"), *closed)
    spec = specs.select("spec_id", "spec_name", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("sep"))
    used = F.col("tokens") + F.col("sep") * (F.col("n_items") - F.col("n_containers"))
    return per.join(spec, "spec_id").select("spec_id", "spec_name", "n_containers", "n_items", "tokens", (used / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used_share"), *(f"closed_by_{x}" for x in LIMITS))
