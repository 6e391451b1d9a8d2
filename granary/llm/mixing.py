"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to the marginals of each. There may be many sources, so
a source's cells are one row of a distributed table and its factor is computed there; languages and topics are few
(MOST_SMALL each, checked), so their factors are numbers in the driver and a round is one aggregation that returns a
number for each pair of them. Documents are then sampled with their cell's calibrated probability.

A sample can't hold more of a cell than there is, so no weight may be over the cell's tokens in it. The budget is lowered
to what the targets allow: the least ratio of what a value has to what it should have. Cells that raking brings over their
tokens are held at these, and the others are raked to what the targets leave, until none is over. Then a cell's
probability is its weight over its tokens, and the expected sample has the marginals. Where targets contradict each
other no sample has them; report says what is expected beside what is asked for.

A target is a share for each value, or a power: shares of the tokens, raised to it. Values without a target keep no
weight. Null values of a dimension are a value of their own, "(none)". Null and empty texts have no tokens; they take
their cell's probability and change no weight; a cell without tokens has probability zero. Very long texts only count.
A draw depends on seed and id alone, so repeated rows are kept or dropped together, and so are null ids. An empty table
gives an empty result. Columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, unit_draw

MOST_SMALL = 1000
BROADCAST_CELLS = 20_000
ROUNDS = 60
TOLERANCE, ROUGH = 1e-6, 1e-3
NONE = "(none)"

Target = float | dict[str, float]


@dataclass(frozen=True)
class Mix:
    """Targets of the three dimensions and the share of all tokens to expect in the sample."""

    source: Target = 0.7
    lang: Target = 0.8
    topic: Target = 1.0
    #: At most; see rake for what the targets allow.
    budget: float = 0.9
    seed: int = 6


def default_tokens(text: Column) -> Column:
    """Estimated tokens of a text: its UTF-8 bytes over four, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def default_topic(text: Column) -> Column:
    """A coarse topic by surface: licensed material, contact data, tables and bars, or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit("License")), "legal").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit(" | ")), "table").otherwise("prose")


def _power(totals: dict[str, float], target: Target) -> dict[str, float]:
    shares = {k: v**target if v > 0 else 0.0 for k, v in totals.items()} if not isinstance(target, dict) else {k: target.get(k, 0.0) if totals[k] > 0 else 0.0 for k in totals}
    whole = sum(shares.values())
    return {k: v / whole for k, v in shares.items()} if whole else shares


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def rake(cells: DataFrame, mix: Mix) -> DataFrame:
    """cells (source, lang, topic, tokens, docs), materialized, with weight and probability: raked shares of the sample,
    which add up to one, and what of the cell's tokens that is.

    Raises ValueError for more than MOST_SMALL languages or topics. A fit ends when the marginals of languages and topics
    move by less than TOLERANCE (those of sources hold by then), or after ROUNDS where targets contradict each other.
    """
    small = {}
    for dim in ("lang", "topic"):
        rows = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).orderBy(dim).limit(MOST_SMALL + 1).collect()
        if len(rows) > MOST_SMALL:
            raise ValueError(f"over {MOST_SMALL} values of {dim}")
        small[dim] = {r[dim]: float(r["t"]) for r in rows}
    whole = sum(small["lang"].values())
    if not whole:
        return cells.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0)})
    goal = {"lang": _power(small["lang"], mix.lang), "topic": _power(small["topic"], mix.topic)}
    own = F.struct("lang", "topic", (F.col("tokens") / F.lit(whole)).alias("share"), F.lit(False).alias("held"))
    by_source = cells.filter("tokens > 0").groupBy("source").agg(F.collect_list(own).alias("cells"), F.sum("tokens").cast("double").alias("all"))
    raw = F.pow("all", F.lit(float(mix.source))) if not isinstance(mix.source, dict) else F.coalesce(F.element_at(_map(mix.source or {"": 0.0}), F.col("source")), F.lit(0.0))
    by_source = materialize(by_source.withColumn("goal", raw), "mix-sources")
    goals = by_source.agg(F.sum("goal")).first()[0] or 1.0
    by_source = by_source.withColumn("goal", F.col("goal") / F.lit(goals))
    room = by_source.filter("goal > 0").agg(F.min(F.col("all") / F.lit(whole) / F.col("goal"))).first()[0] or 1.0
    budget = min([mix.budget, room, *(small[d][k] / whole / g for d in goal for k, g in goal[d].items() if g > 0)])
    factor = {d: {k: float(v > 0) for k, v in goal[d].items()} for d in goal}
    full = lambda x: x["share"] / F.lit(budget)

    def fitted(b: dict[str, float], c: dict[str, float]) -> DataFrame:
        """by_source with w, each cell's weight: held ones have all they can, the others share what the source has left."""
        free = lambda x: F.when(x["held"], 0.0).otherwise(x["share"] * F.element_at(_map(b), x["lang"]) * F.element_at(_map(c), x["topic"]))
        added = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        parts = by_source.withColumns({"_free": F.transform("cells", free), "_held": F.transform("cells", lambda x: F.when(x["held"], full(x)).otherwise(0.0))})
        parts = parts.withColumn("_a", F.when(added("_free") > 0, F.greatest(F.col("goal") - added("_held"), F.lit(0.0)) / added("_free")).otherwise(0.0))
        return parts.withColumn("w", F.zip_with("_free", "_held", lambda x, h: F.col("_a") * x + h)).drop("_free", "_held", "_a")

    def fit(tolerance: float) -> None:
        for _ in range(ROUNDS):
            cell = fitted(factor["lang"], factor["topic"]).select(F.explode(F.arrays_zip("cells", "w")).alias("x")).select("x.cells.lang", "x.cells.topic", "x.cells.held", "x.w")
            sums = cell.groupBy("lang", "topic").agg(F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("w"))).alias("w"), F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0)).alias("h")).collect()
            free, moved = {(r["lang"], r["topic"]): r["w"] for r in sums}, 0.0
            for at, dim in enumerate(("lang", "topic")):
                now, held = dict.fromkeys(goal[dim], 0.0), dict.fromkeys(goal[dim], 0.0)
                for r in sums:
                    now[r[dim]] += free[r["lang"], r["topic"]]
                    held[r[dim]] += r["h"]
                scale = {k: max(g - held[k], 0.0) / now[k] if now[k] > 0 else 1.0 for k, g in goal[dim].items()}
                moved = max([moved, *(abs(now[k] + held[k] - g) for k, g in goal[dim].items())])
                factor[dim] = {k: v * scale[k] for k, v in factor[dim].items()}
                free = {key: w * scale[key[at]] for key, w in free.items()}
            if moved < tolerance:
                break

    # Which cells are held shows in a rough fit already; the fine one comes when none is over any more.
    tolerance = ROUGH
    for _ in range(ROUNDS):
        fit(tolerance)
        over = lambda x, w: ~x["held"] & (w > full(x) * (1 + 10 * tolerance))  # noqa: E731, B023
        held = F.zip_with("cells", "w", lambda x, w: F.struct(x["lang"].alias("lang"), x["topic"].alias("topic"), x["share"].alias("share"), (x["held"] | over(x, w)).alias("held")))
        seen = fitted(factor["lang"], factor["topic"])
        if seen.filter(F.exists(F.arrays_zip("cells", "w"), lambda y: over(y["cells"], y["w"]))).isEmpty():
            if tolerance == TOLERANCE:
                break
            tolerance = TOLERANCE
            continue
        by_source = materialize(seen.withColumn("cells", held).drop("w"), "mix-sources")
    final = fitted(factor["lang"], factor["topic"]).select(F.col("source").alias("_s"), F.explode(F.arrays_zip("cells", "w")).alias("x"))
    final = final.select("_s", F.col("x.cells.lang").alias("_l"), F.col("x.cells.topic").alias("_t"), F.col("x.w").alias("weight"), F.round(F.least(F.lit(1.0), F.col("x.w") / full(F.col("x.cells"))), 9).alias("probability"))
    met = cells.join(final, (F.col("source") == F.col("_s")) & (F.col("lang") == F.col("_l")) & (F.col("topic") == F.col("_t")), "left")
    return met.select(*cells.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("weight", "probability")])


def report(mixed: DataFrame, plan: Mix | None = None) -> DataFrame:
    """(dimension, value, share, target, expected): each value's share of the tokens, of its dimension's target and of the
    tokens expected in the sample, over the result of mix."""
    plan, out = plan or Mix(), None
    for dim, target in (("source", plan.source), ("lang", plan.lang), ("topic", plan.topic)):
        sums = mixed.groupBy(F.col(f"mix_{dim}").alias("value")).agg(F.sum("mix_tokens").cast("double").alias("t"), F.sum(F.col("mix_tokens") * F.col("probability")).alias("e"))
        raw = F.when(F.col("t") > 0, F.pow("t", F.lit(float(target))) if not isinstance(target, dict) else F.coalesce(F.element_at(_map(target or {"": 0.0}), F.col("value")), F.lit(0.0))).otherwise(0.0)
        sums = sums.withColumn("g", raw)
        totals = sums.agg(*[F.sum(c).alias(f"_{c}") for c in ("t", "g", "e")])
        rows = sums.join(F.broadcast(totals)).select(F.lit(dim).alias("dimension"), "value", *[F.try_divide(c, f"_{c}").alias(n) for c, n in (("t", "share"), ("g", "target"), ("e", "expected"))])
        out = rows if out is None else out.unionByName(rows)
    return out


def mix(docs: DataFrame, plan: Mix | None = None, id_col: str = "doc_id", source: Column | None = None, lang: Column | None = None, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, probability and sampled."""
    added = ["mix_source", "mix_lang", "mix_topic", "mix_tokens", "probability", "sampled"]
    plan = plan or Mix()
    text = F.col("text")
    # Rows travel as one struct, so no column of theirs can clash.
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.coalesce((F.col("source") if source is None else source).cast("string"), F.lit(NONE)).alias("mix_source"),
        F.coalesce((F.col("lang") if lang is None else lang).cast("string"), F.lit(NONE)).alias("mix_lang"),
        F.coalesce((default_topic(text) if topic is None else topic).cast("string"), F.lit(NONE)).alias("mix_topic"),
        (default_tokens(text) if tokens is None else tokens).cast("long").alias("mix_tokens"),
    )
    keys = ["mix_source", "mix_lang", "mix_topic"]
    cells = named.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs"))
    cells = materialize(cells.select(*[F.col(k).alias(k.removeprefix("mix_")) for k in keys], "tokens", "docs"), "mix-cells")
    table = materialize(rake(cells, plan), "mix-probabilities")
    right = table.select(*[F.col(k.removeprefix("mix_")).alias(k) for k in keys], "probability", F.col("docs").alias("_docs"))
    if table.count() <= BROADCAST_CELLS:
        joined = named.join(F.broadcast(right.drop("_docs")), keys, "left")
    else:
        total = table.agg(F.sum("docs")).first()[0]
        joined = attach(named.withColumn("_id", F.col("_doc")[id_col]), right, keys, ["probability"], "_docs", total, "_id")
    own = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in added]
    return joined.withColumn("sampled", unit_draw(F.col("_doc")[id_col], plan.seed) < F.col("probability")).select(*own, *added)
