"""Comparison of typed predicates: an ordered outcome from exact agreement to contradiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of outcomes; a join of outcomes is their maximum.
EXACT, PARTIAL, NO_TYPED_MEET, CONTRADICTION = range(4)

#: A role's argument; status is bound, variable or another word.
ARGUMENT = "struct<value: string, entity_type: string, status: string>"


def _clash(a: Column, b: Column) -> Column:
    """Arguments that can't be one: types differ, or both are bound to different values."""
    types = a["entity_type"].isNotNull() & b["entity_type"].isNotNull() & (a["entity_type"] != b["entity_type"])
    return types | ((a["status"] == "bound") & (b["status"] == "bound") & ~a["value"].eqNullSafe(b["value"]))


def meet(a: str, b: str) -> Column:
    """The outcome of two struct columns (signature, domain, roles map, polarity, qualifiers map).

    In order: other signature or domain, or no shared role: no typed meet; a shared role clashes:
    contradiction; a shared qualifier differs: no typed meet; a qualifier is missing: partial; polarity
    differs: contradiction; a role is missing: partial; else exact."""
    x, y = F.col(a), F.col(b)
    shared = F.array_intersect(F.map_keys(x["roles"]), F.map_keys(y["roles"]))
    clash = F.exists(shared, lambda r: _clash(F.element_at(x["roles"], r), F.element_at(y["roles"], r)))
    qualifiers = F.array_intersect(F.map_keys(x["qualifiers"]), F.map_keys(y["qualifiers"]))
    differ = F.exists(qualifiers, lambda q: ~F.element_at(x["qualifiers"], q).eqNullSafe(F.element_at(y["qualifiers"], q)))
    lacking = lambda f: (F.size(F.array_except(F.map_keys(x[f]), F.map_keys(y[f]))) > 0) | (F.size(F.array_except(F.map_keys(y[f]), F.map_keys(x[f]))) > 0)
    return (
        F.when((x["signature"] != y["signature"]) | ~x["domain"].eqNullSafe(y["domain"]) | (F.size(shared) == 0), NO_TYPED_MEET)
        .when(clash, CONTRADICTION)
        .when(differ, NO_TYPED_MEET)
        .when(lacking("qualifiers"), PARTIAL)
        .when(x["polarity"] != y["polarity"], CONTRADICTION)
        .when(lacking("roles"), PARTIAL)
        .otherwise(EXACT)
    )


def residual_join(rows: DataFrame, key: str, level: str) -> DataFrame:
    """key, level: the least upper bound of each key's outcomes."""
    return rows.groupBy(key).agg(F.max(level).alias(level))


def candidates(queries: DataFrame, atoms: DataFrame) -> DataFrame:
    """query and atom structs with one signature where the atom has all of the query's bound arguments; the filter before meet()."""
    q = queries.select(F.col("query"), F.col("query.signature").alias("_s"))
    a = atoms.select(F.col("atom"), F.col("atom.signature").alias("_s"))
    bound = F.forall(F.map_entries("query.roles"), lambda e: (e["value"]["status"] != "bound") | F.element_at("atom.roles", e["key"])["value"].eqNullSafe(e["value"]["value"]))
    return q.join(a, "_s").filter(bound).drop("_s")


def fibre_outcome(support: Column, contradict: Column, applicable: Column) -> Column:
    """inapplicable, both, satisfied, violated or undetermined."""
    return F.when(~applicable, "inapplicable").when(support & contradict, "both").when(support, "satisfied").when(contradict, "violated").otherwise("undetermined")


def claim_relation(a: str, b: str) -> Column:
    """How one typed claim (s, p, o, polarity, text, procedural) answers another."""
    x, y = F.col(a), F.col(b)
    spo = (x["s"] == y["s"]) & (x["p"] == y["p"]) & (x["o"] == y["o"])
    return F.when(y["procedural"], "procedural_nonanswer").when(spo & (x["polarity"] != y["polarity"]), "explicit_dispute").when((x["text"] == y["text"]) | spo, "exact_support").when((x["s"] == y["s"]) | (x["p"] == y["p"]), "partial_overlap").otherwise("unrelated")


def argument_conflict(a: Column, b: Column) -> Column:
    """Whether two arguments (value, entity_type, status) of one role can't be one: their types differ, or neither side is open and the values differ.

    An unresolved or variable side takes the other's value."""
    types = a["entity_type"].isNotNull() & b["entity_type"].isNotNull() & (a["entity_type"] != b["entity_type"])
    is_open = lambda x: x["status"].isin("unresolved", "variable")
    refines = is_open(a) != is_open(b)
    return types | (~refines & ~a["value"].eqNullSafe(b["value"]))


def joined_argument(a: Column, b: Column) -> Column:
    """The argument that two compatible ones make: the settled side's value, the first known type, the stronger status (bound, variable, other)."""
    is_open = lambda x: x["status"].isin("unresolved", "variable")
    rank = lambda x: F.when(x["status"] == "bound", 2).when(x["status"] == "variable", 1).otherwise(0)
    value = F.when(is_open(a) & ~is_open(b), b["value"]).otherwise(a["value"])
    return F.struct(value.alias("value"), F.coalesce(a["entity_type"], b["entity_type"]).alias("entity_type"), F.when(rank(a) >= rank(b), a["status"]).otherwise(b["status"]).alias("status"))


def join_roles(a: Column, b: Column) -> tuple[Column, Column]:
    """(joined role map, conflicting roles in order) of two role maps. A role that conflicts keeps the first side's argument."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    conflicts = F.array_sort(F.filter(shared, lambda r: argument_conflict(F.element_at(a, r), F.element_at(b, r))))
    bad = lambda k: F.array_contains(conflicts, k)
    joined = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull() | bad(k), x).otherwise(joined_argument(x, y)))
    return joined, conflicts


def access_path(ref: Column, cand: Column) -> Column:
    """How a reference reaches a candidate, by structs of start, quotation_depth, reporting, clause, coordination, sentence, paragraph: the first that fits."""
    both = lambda f: ref[f].isNotNull() & cand[f].isNotNull()
    same = lambda f: F.coalesce(ref[f] == cand[f], F.lit(False))
    quoted = both("quotation_depth") & (ref["quotation_depth"] != cand["quotation_depth"])
    return (
        F.when(cand["start"] >= ref["start"], "not_preceding_reference")
        .when(quoted & (ref["reporting"].isNotNull() | cand["reporting"].isNotNull()), "reporting_content_boundary")
        .when(quoted, "quotation_boundary_crossed")
        .when(same("clause"), "same_clause")
        .when(same("reporting"), "governing_clause")
        .when(same("coordination"), "preceding_coordinated_clause")
        .when(same("sentence"), "same_sentence")
        .when(same("paragraph"), "preceding_discourse_unit")
        .when(both("paragraph") & (cand["paragraph"] < ref["paragraph"]), "preceding_paragraph")
        .otherwise("preceding_document_unit")
    )
