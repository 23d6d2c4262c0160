"""Scores and grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def harm_score(lost: Column, delay: Column, intimidation: Column, cooperation: Column) -> tuple[Column, Column]:
    """Score from 0 to 1 and its level: 0.2 for each loss, up to 0.6 for a delay of 12, 0.2 more for intimidation, 0.1 less for cooperation."""
    raw = F.least(F.lit(12.0), delay) / 12.0 * 0.6 + F.when(intimidation, 0.2).otherwise(0.0) - F.when(cooperation, 0.1).otherwise(0.0) + 0.2 * lost
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return score, F.when(score < 0.33, "Low").when(score < 0.66, "Medium").otherwise("High")


def capture_summary(captures: DataFrame, when: str, app: str, covered: Column) -> DataFrame:
    """One row: total, first and last day, share of covered rows, number of apps."""
    return captures.agg(
        F.count("*").alias("total"), F.date_format(F.min(when), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(when), "yyyy-MM-dd").alias("last_day"),
        F.round(F.sum(covered.cast("int")) / F.count("*"), 6).alias("coverage"), F.countDistinct(app).alias("apps"),
    )


def structure_report(atoms: DataFrame, unit: str, atom: str, kind: str) -> DataFrame:
    """atom, count, unit_count, reuse_ratio, neighbours, cross_kind, utility over atoms(unit, atom, kind).

    Neighbours are distinct atoms of the same unit, cross_kind those of another kind. Units are grouped
    into their sets of atoms first, so equal units are paired once."""
    counts = atoms.groupBy(atom, kind).agg(F.count("*").alias("count"), F.countDistinct(unit).alias("unit_count"))
    sets = atoms.groupBy(unit).agg(F.array_sort(F.collect_set(F.struct(F.col(atom).alias("a"), F.col(kind).alias("k")))).alias("_s")).select("_s").distinct()
    pairs = sets.select("_s", F.explode("_s").alias("_x")).select("_x", F.explode("_s").alias("_y")).filter("_x <> _y").distinct()
    near = pairs.groupBy(F.col("_x.a").alias(atom)).agg(F.countDistinct("_y.a").alias("neighbours"), F.countDistinct(F.when(F.col("_x.k") != F.col("_y.k"), F.col("_y.a"))).alias("cross_kind"))
    rows = counts.join(near, atom, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("neighbours", "cross_kind")})
    boundary = F.col(kind).isin("message_ref", "quote_ref", "code_ref")
    once = (F.col("count") == 1) & (F.col("unit_count") == 1)
    utility = 2 * F.col("count") + 3 * F.col("unit_count") + 4 * F.col("neighbours") + 2 * F.col("cross_kind") - F.when(boundary, 3).otherwise(0) - F.when(once, 4).otherwise(0)
    return rows.select(atom, kind, "count", "unit_count", F.round(1 - 1 / F.col("count"), 6).alias("reuse_ratio"), "neighbours", "cross_kind", utility.alias("utility"))


def neighbourhood(tokens: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """term, side (previous or next), neighbour, n: what stands next to the terms in tokens(key, pos, token)."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = tokens.withColumn("_p", F.lag("token").over(w)).withColumn("_n", F.lead("token").over(w)).filter(F.col("token").isin(*terms))
    sides = rows.select(F.col("token").alias("term"), F.explode(F.create_map(F.lit("previous"), F.col("_p"), F.lit("next"), F.col("_n"))).alias("side", "neighbour"))
    return sides.filter("neighbour is not null").groupBy("term", "side", "neighbour").agg(F.count("*").alias("n"))


def assembled_events(observations: DataFrame, statement: str, order: str, roles: Sequence[str]) -> DataFrame:
    """Events from observations(statement, order, role, value, abstained): the first value of each role in a statement, statements
    with equal roles as one event, with a confidence; events without an actor are left out."""
    told = observations.filter("not abstained")
    firsts = told.groupBy(statement).agg(*[F.min_by(F.when(F.col("role") == r, F.col("value")), F.when(F.col("role") == r, F.col(order))).alias(r) for r in roles])
    merged = firsts.groupBy(*roles).agg(F.count("*").alias("statements"), F.min(statement).alias("first_statement")).filter("primary_actor is not null")
    weight = {"event_type": 0.25, "primary_actor": 0.2, "object_text": 0.1, "time_start": 0.1}
    score = F.lit(0.35) + sum((F.when(F.col(r).isNotNull(), weight.get(r, 0.0)).otherwise(0.0) for r in roles), F.lit(0.0))
    return merged.withColumn("confidence", F.round(F.least(F.lit(0.99), score), 4))


def converging(claims: DataFrame, claim: Sequence[str], source: str, least: int) -> DataFrame:
    """Claims that so many independent sources make."""
    return claims.groupBy(*claim).agg(F.countDistinct(source).alias("sources")).filter(F.col("sources") >= least)


def policy_outcomes(facts: DataFrame, signals: str) -> DataFrame:
    """facts with a policy from their signal classes: the first that applies."""
    has = lambda *names: F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))
    return facts.withColumn("policy", F.when(has("contested"), "manual_resolution_required").when(has("public_summary"), "do_not_promote_to_primary").when(has("quoted"), "preserve_source_boundary").when(has("fragment"), "bounded_context_required").otherwise("review_required"))


def related_facts(facts: DataFrame, case: str, key: str, side_a: Column, side_b: Column) -> DataFrame:
    """case, a_count, b_count, relations: how many a-b pairs a case has, without making them."""
    flagged = facts.select(case, side_a.cast("long").alias("_a"), side_b.cast("long").alias("_b"))
    g = flagged.groupBy(case).agg(F.sum("_a").alias("a_count"), F.sum("_b").alias("b_count"), F.sum(F.col("_a") * F.col("_b")).alias("_both"))
    return g.select(case, "a_count", "b_count", (F.col("a_count") * F.col("b_count") - F.col("_both")).alias("relations"))


def micro_scores(gold: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, precision and recall of found against gold; where nothing was to be found or was found, 1."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    n = g.join(f, list(keys), "full_outer").agg(F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    share = lambda of: F.when(F.col("tp") + F.col(of) == 0, 1.0).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col(of)), 6))
    return n.select("tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


def top_counts(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a column (null counts as empty; ties by value) and how often each occurs."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


#: Fixed weights of a cloud's nodes.
CLOUD = {"exact": 0.4, "jurisdiction": 0.2, "recency": 0.2, "rank": 0.2}


def cloud_score(exact: Column, jurisdiction: Column, days: Column, rank: Column) -> Column:
    """How near a node is to a query: exactness and jurisdiction (0 to 1), age in days (null: undated) and a court's rank (null: none; larger ranks count less)."""
    parts = (F.coalesce(exact, F.lit(0.0)) * CLOUD["exact"], F.coalesce(jurisdiction, F.lit(0.0)) * CLOUD["jurisdiction"], F.coalesce(1 / (1 + days / 365) * CLOUD["recency"], F.lit(0.0)), F.coalesce(1 / (1 + rank) * CLOUD["rank"], F.lit(0.0)))
    return parts[0] + parts[1] + parts[2] + parts[3]


def promotion_gates(spans: DataFrame, signals: DataFrame, doc: str, least: int = 3, gap: int = 200) -> DataFrame:
    """spans(doc, start, end, label, role, modal) with gate and status: the first gate that fits decides.

    In order: no label (rejected); a span of signals(doc, start, end) overlaps (blocked); a defined term
    (promoted); a label repeated in its document (promoted); an actor, object or construct beside a modal
    word (promoted); else none (rejected). Rows need a key of their own: span_id."""
    from .joins import interval_join
    from .text_stats import repeated_labels

    name = F.lower(F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", " ")))
    rows = spans.withColumn("label", name)
    own = rows.select(doc, "span_id", F.col("start").alias("a_s"), F.col("end").alias("a_e"))
    other = signals.select(doc, F.col("start").alias("b_s"), F.col("end").alias("b_e"))
    hit = interval_join(own, other, [doc], 256, ("a_s", "a_e"), ("b_s", "b_e")).select("span_id").distinct().withColumn("_blocked", F.lit(True))
    often = repeated_labels(rows, doc, "label", "start", least, gap).select(doc, "label", F.lit(True).alias("_often"))
    rows = rows.join(hit, "span_id", "left").join(often, [doc, "label"], "left")
    gate = (
        F.when(F.col("label") == "", "no_label").when(F.col("_blocked"), "signal_block").when(F.col("role") == "defined_term", "defined_term").when(F.col("_often"), "repetition")
        .when(F.col("role").isin("actor", "object", "construct") & F.col("modal"), "modal_participation").otherwise("no_gate")
    )
    status = F.when(gate.isin("no_label", "no_gate"), "rejected").when(gate == "signal_block", "blocked").otherwise("promoted")
    return rows.select(*spans.columns, gate.alias("gate"), status.alias("status"))


def braid_relevance(events: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """event, connectedness, referentiality, depth, score, status of events(event, cluster_size, families, conflict, closed, dated, sourced, blocked).

    links(left, right) join candidates, edges(src, dst, basis) order events; the order by historical time
    has no cycle. Depth is the longest path from a source plus that to a sink."""
    from .graph import longest_paths

    ends = links.select(F.col("left").alias("event")).unionByName(links.select(F.col("right").alias("event"))).unionByName(edges.select(F.col("src").alias("event"))).unionByName(edges.select(F.col("dst").alias("event")))
    degree = ends.groupBy("event").agg(F.count("*").alias("_degree"))
    timed = edges.filter("basis = 'historical_time_order'").select("src", "dst")
    down = longest_paths(timed).select(F.col("node").alias("event"), F.col("depth").alias("_down"))
    up = longest_paths(timed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("event"), F.col("depth").alias("_up"))
    rows = events.join(degree, "event", "left").join(down, "event", "left").join(up, "event", "left")
    zero = F.lit(0)
    rows = rows.withColumn("connectedness", (F.coalesce("_degree", zero) + F.coalesce("cluster_size", F.lit(1)) - 1).cast("double")).withColumn("referentiality", F.col("families").cast("double")).withColumn("depth", (F.coalesce("_down", zero) + F.coalesce("_up", zero)).cast("double"))
    raw = F.col("connectedness") * 0.3 + F.col("referentiality") * 0.2 + F.col("depth") * 0.1 + (F.col("connectedness") + F.col("referentiality")) * 0.1 + F.when(F.col("referentiality") >= 2, 0.2).otherwise(0.0) - F.when(F.col("conflict"), 0.3).otherwise(0.0)
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 2))))
    ready = F.col("closed") & F.col("dated") & F.col("sourced") & (F.col("score") >= 0.5)
    status = F.when(F.col("blocked"), "excluded").when(ready, "timeline_candidate").when(F.col("score") >= 0.4, "triage").otherwise("background")
    return rows.select("event", "connectedness", "referentiality", "depth", "score", status.alias("status"))


#: Fixed weights of a description's measures; rounds join by their maximum, the others by their sum.
MEASURES = {"nodes": 1.0, "edges": 0.75, "alternatives": 2.0, "unresolved": 3.0, "boundaries": 4.0, "bytes": 1 / 1024, "rules": 0.5, "rounds": 1.0, "nanoseconds": 1e-6, "promoted": 0.25, "interfaces": 0.5, "hierarchy": 0.25}


def description_length(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, the joined measures that parts has, and mdl, their weighted sum."""
    here = [m for m in MEASURES if m in parts.columns]
    joined = parts.groupBy(*by).agg(*[(F.max(m) if m == "rounds" else F.sum(m)).alias(m) for m in here])
    total = F.lit(0.0)
    for m in here:
        total = total + F.coalesce(F.col(m), F.lit(0)) * F.lit(MEASURES[m])
    return joined.withColumn("mdl", total)
