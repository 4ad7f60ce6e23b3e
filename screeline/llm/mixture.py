"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted in tokens and summed by (source, language, topic).  Weights of these
cells are raked to the sources' target shares and to the language and topic shares of the
corpus, no weight above the repeats that its source allows.  A document is then taken as
often as the whole part of its cell's weight says, and once more with the probability of
the rest, by systematic sampling within the cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screeline.llm.tokens import BYTE_BPE, with_tokens
from screeline.llm.topics import learn_topics
from screeline.staging import Staging

LARGEST_RECIPE = 10_000
LARGEST_PLAN = 2_000_000
LARGEST_BROADCAST = 100_000


def clean_source(source: Column) -> Column:
    """A source's name in lower case, without padding, with underscores for blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def clean_language(lang: Column) -> Column:
    """A language tag in lower case without padding; null, blank and unknown ones are 'und'."""
    tag = F.lower(F.trim(lang))
    return F.when(tag.isNull() | (tag == ""), F.lit("und")).otherwise(tag)


@dataclass
class Plan:
    """The cells' weights and what each source of the recipe can and does give."""

    weights: list[tuple[str, str, str, float, int]]  # source, language, topic, weight, documents
    sources: list[dict]  # source, target_share, max_repeats, tokens, capacity, planned_tokens, reachable, planned_share
    margins: list[dict]  # margin, value, wanted_share, planned_share
    size: float


def rake(cells: list[dict], shares: dict[str, float], repeats: dict[str, float], size: float, rounds: int = 5_000, settled: float = 1e-6) -> np.ndarray:
    """The weights of cells (source, lang, topic, tokens).

    Sources of the recipe that can't reach their share give all they may; the others make up
    for them in the proportion of their shares.  Languages and topics keep, as far as the
    sources and the caps leave room, the shares they have among the recipe's sources.  Ends when
    a round moves less than the share ``settled`` of all tokens; an error if ``rounds`` rounds do
    not get there.
    """
    source, lang, topic = (np.array([c[k] for c in cells], dtype=object) for k in ("source", "lang", "topic"))
    tokens = np.array([float(c["tokens"]) for c in cells])
    cap = np.array([repeats.get(s, 0.0) for s in source])
    usable = (cap > 0) & (tokens > 0)
    weight = np.where(usable, 1.0, 0.0)
    if not usable.any():
        return weight
    sums = lambda key, v: {k: v[key == k].sum() for k in set(key)}
    have = {s: t for s, t in sums(source[usable], tokens[usable]).items()}
    # the tokens each source shall give: what can't be reached is shared out again
    goal, room, open_ = {}, size, {s: shares[s] for s in have if shares[s] > 0}
    while open_:
        unit = room / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit > have[s] * repeats[s]]
        if not full:
            goal |= {s: share * unit for s, share in open_.items()}
            break
        for s in full:
            goal[s] = have[s] * repeats[s]
            room -= goal[s]
            del open_[s]
    total = sum(goal.values())
    base = tokens * np.where(usable, 1.0, 0.0)
    margins = [(lang, {k: v / base.sum() * total for k, v in sums(lang, base).items()}), (topic, {k: v / base.sum() * total for k, v in sums(topic, base).items()}), (source, {s: goal.get(s, 0.0) for s in set(source)})]
    for _ in range(rounds):
        before = weight.copy()
        for key, want in margins:
            now = sums(key, weight * tokens)
            weight = np.minimum(weight * np.array([want[k] / now[k] if now[k] > 0 else 0.0 for k in key]), cap)
        moved = float((np.abs(weight - before) * tokens).sum())
        if moved < settled * size:
            break
    else:
        raise RuntimeError(f"the weights did not settle in {rounds} rounds: {moved:.0f} tokens moved in the last")
    for s, want in goal.items():  # the sources' shares hold exactly: fill what the caps cut off
        mine = (source == s) & usable
        for _ in range(100):
            now = (weight[mine] * tokens[mine]).sum()
            free = mine & (weight < cap * (1 - 1e-12))
            lack = want - now
            if lack <= 1e-9 * max(want, 1.0) or not free.any():
                break
            part = (weight[free] * tokens[free]).sum()
            weight[free] = np.minimum(weight[free] * (1 + lack / part) if part > 0 else lack / tokens[free].sum(), cap[free])
    return weight


def mixture_plan(documents: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tokenizer: str = BYTE_BPE, topics: int = 8, size: float | None = None, rare: float = 0.001, staging: Staging | None = None) -> tuple[DataFrame, Plan]:
    """(counted, plan): the documents with source, lang, topic and tokens, and the plan of a
    mixture of ``size`` tokens (those of all documents by default).

    ``target`` is (source, target_share, max_repeats), at most ten thousand rows; rows that name
    a source again add their shares.  Languages with less than the share ``rare`` of all tokens
    are one, so the cells, which the driver rakes, are bounded by the recipe.  Sources outside
    the recipe and null sources count in the corpus and are never drawn; null texts have no tokens.
    """
    staging = staging or Staging(documents.sparkSession, "mixture")
    rows = documents.withColumn("_source", F.coalesce(clean_source(F.col(f"`{source}`")), F.lit(""))).withColumn("_lang", clean_language(F.col(f"`{lang}`")))
    sized = with_tokens(rows, text, [doc_id, "_source", "_lang"], tokenizer, words=True)
    sized = staging.put("sized", sized.select(F.col(f"`{doc_id}`").alias("doc"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), "tokens", "words"))
    counted = staging.put("counted", learn_topics(sized, "words", topics).label(sized, "words"))
    staging.drop("sized")
    recipe = target.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("repeats"))
    recipe = recipe.filter("source is not null").groupBy("source").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("repeats"), F.lit(0.0)).alias("repeats"))
    named = recipe.limit(LARGEST_RECIPE + 1).collect()
    if len(named) > LARGEST_RECIPE:
        raise ValueError(f"a recipe names at most {LARGEST_RECIPE} sources")
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0]
    common = [r["lang"] for r in counted.groupBy("lang").agg(F.sum("tokens").alias("t")).filter(F.col("t") >= max(1.0, rare * total)).collect()]
    counted = counted.withColumn("lang", F.when(F.col("lang").isin(common), F.col("lang")).otherwise("other"))
    within = counted.filter(F.col("source").isin([r["source"] for r in named]))
    cells = within.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("source", "lang", "topic").limit(LARGEST_PLAN + 1).collect()
    if len(cells) > LARGEST_PLAN:
        raise ValueError(f"a plan holds at most {LARGEST_PLAN} cells of source, language and topic")
    cells = [r.asDict() for r in cells]
    size = float(total if size is None else size)
    shares, repeats = {r["source"]: r["share"] for r in named}, {r["source"]: r["repeats"] for r in named}
    weight = rake(cells, shares, repeats, size)
    report = []
    planned = float(sum(w * c["tokens"] for w, c in zip(weight, cells)))
    for s in sorted(shares):
        have = sum(c["tokens"] for c in cells if c["source"] == s)
        mine = float(sum(w * c["tokens"] for w, c in zip(weight, cells) if c["source"] == s))
        capacity = have * repeats[s]
        # the raked and capped weights tell whether the share is reached
        reachable = mine >= shares[s] * size * (1 - 1e-6)
        report.append({"source": s, "target_share": float(shares[s]), "max_repeats": repeats[s], "tokens": int(have), "capacity": float(capacity), "planned_tokens": mine, "reachable": bool(reachable), "planned_share": mine / planned if planned else 0.0})
    usable = [repeats.get(c["source"], 0.0) > 0 for c in cells]
    base = float(sum(c["tokens"] for c, u in zip(cells, usable) if u)) or 1.0
    margins = []
    for margin in ("lang", "topic"):
        for value in sorted({c[margin] for c in cells}):
            mine = [(w, c["tokens"], u) for w, c, u in zip(weight, cells, usable) if c[margin] == value]
            margins.append({"margin": margin, "value": value, "wanted_share": sum(t for _, t, u in mine if u) / base, "planned_share": float(sum(w * t for w, t, _ in mine)) / planned if planned else 0.0})
    return counted, Plan([(c["source"], c["lang"], c["topic"], float(w), int(c["n"])) for w, c in zip(weight, cells)], report, margins, size)


_REPORT = "source string, target_share double, max_repeats double, tokens long, capacity double, planned_tokens double, reachable boolean, planned_share double"


def plan_report(spark, plan: Plan) -> DataFrame:
    """One row for each source of the recipe: what it has, may give and shall give."""
    columns = [f.split()[0] for f in _REPORT.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in plan.sources], _REPORT)


def margin_report(spark, plan: Plan) -> DataFrame:
    """(margin, value, wanted_share, planned_share): the shares of languages and topics that the
    recipe's sources have and that the plan keeps, where its sources and caps leave room."""
    rows = [(m["margin"], m["value"], m["wanted_share"], m["planned_share"]) for m in plan.margins]
    return spark.createDataFrame(rows, "margin string, value string, wanted_share double, planned_share double")


def draw(counted: DataFrame, plan: Plan, seed: int = 11, cell_rows: int = 10_000) -> DataFrame:
    """(doc, source, lang, topic, tokens, repeats): the documents of the mixture.

    Within a cell, cut by a hash into parts of about ``cell_rows`` rows, documents in the order
    of a hash are taken once more whenever the running sum of the weights' fractions passes a
    whole number, from a random start.
    """
    spark = counted.sparkSession
    rows = [(s, la, t, w, max(1, n // cell_rows)) for s, la, t, w, n in plan.weights if w > 0]
    weights = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, parts long")
    # a row a cell: broadcast up to a size, beyond it left to the optimiser
    d = counted.join(F.broadcast(weights) if len(rows) <= LARGEST_BROADCAST else weights, ["source", "lang", "topic"])
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), "doc")).withColumn("_part", F.pmod("_h", F.col("parts")))
    key = ["source", "lang", "topic", "_part"]
    d = d.withColumn("_rest", F.col("weight") - F.floor("weight"))
    run = F.sum("_rest").over(Window.partitionBy(*key).orderBy("_h", "doc").rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_003)) / 1_000_003
    once = F.floor(run + start + 1e-12) - F.floor(run - F.col("_rest") + start + 1e-12)
    d = d.withColumn("repeats", (F.floor("weight") + once).cast("long")).filter("repeats > 0")
    return d.select("doc", "source", "lang", "topic", "tokens", "repeats")


def drawn_report(counted: DataFrame, plan: Plan, seed: int = 11) -> DataFrame:
    """The plan's report with the tokens and share that the drawn mixture really holds."""
    mixture = draw(counted, plan, seed)
    sums = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    all_of = sums.agg(F.sum("drawn_tokens")).collect()[0][0] or 1
    report = plan_report(counted.sparkSession, plan).join(F.broadcast(sums), "source", "left")
    report = report.withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
    return report.withColumn("actual_share", F.col("drawn_tokens") / all_of)
