"""Secret scans over a trigram inverted index, in Spark expressions only.

Each rule's regular expression is parsed into the strings it must contain, and those into a Boolean
query of trigrams (ANDs and ORs). The index holds, for each block of documents, the postings of the
trigrams that some rule asks for. A query intersects and unites postings; its candidates are joined
back and verified by the regular expression itself. Rules without mandatory trigrams scan every text.
Of the trigrams that a string asks for together only the rarest are looked up: fewer passes over each
text for a few more candidates, none of them missed.

Postings are kept by block (about ``BLOCK_DOCS`` documents by a hash of their key), so no list grows
with the corpus. The index folds letter case; that only adds candidates. Texts that a filter of the
candidates' keys rules out aren't moved; the others are joined with their rules.

Spans are code points, end exclusive. Defined results: null and empty texts have no spans, an empty table
gives no rows; texts of any length are read whole, and their spans are listed in blocks; of spans that
start together the earlier kind comes first; repeated rows come out once each; a null doc_id is a key like
any other; columns that a caller keeps travel packed in a struct, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import IGNORECASE
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, possible, stored, text_of

BLOCK_DOCS = 4096
PLACEHOLDER = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has at_least characters; others are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: Fixed by contract: the base kinds, in order. A run's length bound is part of the pattern where every
#: shorter match is dropped anyway and can't hide a longer one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds that the operator adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# A query: True (asks for nothing), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
_MOST = 64


def _all(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if kind == "or" or p is not True))
    if kind == "or" and True in parts:
        return True
    if kind == "or":  # what asks for more than another alternative says nothing new
        asked = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
        parts = [p for p, own in zip(parts, asked, strict=True) if not any(other < own for other in asked)]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text must have if it contains one of the strings."""
    return _all("or", [_all("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, value) -> tuple[frozenset[str] | None, Query]:
    """The strings a piece of a pattern stands for (None: too many), and its query."""
    if op is sre.LITERAL:
        return frozenset({chr(value).lower()}), True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(e is not None for e, _ in parts) and len(union := frozenset().union(*(e for e, _ in parts))) <= _MOST:
            return union, True
        return None, _all("or", [q if e is None else _of_strings(e) for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, True
        if exact is not None and least == most and len(exact) ** least <= _MOST:
            return frozenset(reduce(lambda a, _: {x + y for x in a for y in exact}, range(least), {""})), True
        return None, True if not least else query if exact is None else _of_strings(exact)
    if op is sre.AT:
        return frozenset({""}), True
    return None, True


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    now, found, exact = frozenset({""}), [], True
    for op, value in nodes:
        strings, query = _node(op, value)
        if strings is not None and len(now) * len(strings) <= _MOST:
            now = frozenset(a + b for a in now for b in strings)
            continue
        exact = False
        found += [_of_strings(now), query]
        now = strings if strings is not None else frozenset({""})
    return (now, True) if exact else (None, _all("and", [*found, _of_strings(now)]))


def trigram_query(pattern: str) -> Query:
    exact, query = _sequence(parser.parse(pattern, IGNORECASE if pattern.startswith("(?i)") else 0))
    return query if exact is None else _of_strings(exact)


def _trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


#: Letters by how common they are in European prose; other characters count as rarer than e to g.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"


def _rarity(trigram: str) -> tuple[int, str]:
    return sum(_COMMON.find(c) if c in _COMMON else 16 for c in trigram), trigram


def thinned(query: Query) -> Query:
    """A weaker query: of trigrams that must all be there the two rarest, of fewer than four the rarest."""
    if query is True or isinstance(query, str):
        return query
    kind, parts = query
    if kind == "or":
        return _all("or", [thinned(p) for p in parts])
    leaves = sorted((p for p in parts if isinstance(p, str)), key=_rarity, reverse=True)
    return _all("and", [*leaves[: 2 if len(leaves) > 3 else 1], *[thinned(p) for p in parts if not isinstance(p, str)]])


def _run(query: Query, postings: Column) -> Column:
    """The keys that satisfy a query, from a block's map of postings."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(postings, query), F.array().cast("array<bigint>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [_run(q, postings) for q in query[1]])


def build_index(docs: DataFrame, trigrams: set[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """block, trigram, postings (keys of documents that contain it) of docs(_key, _text)."""
    n_blocks = max(1, -(-docs.count() // block_docs))
    # Letter case is folded once for each text, before the look-ups.
    low = docs.select("_key", F.lower("_text").alias("_low"))
    named = low.select("_key", F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)])).alias("found"))
    rows = named.select(F.pmod("_key", F.lit(n_blocks)).alias("block"), F.explode("found").alias("trigram"), "_key")
    return rows.groupBy("block", "trigram").agg(F.collect_set("_key").alias("postings"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """_key, rules: the documents that satisfy the queries, with the numbers of those queries."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("postings"))

    def named(number: int, query: Query) -> Column:
        return F.transform(_run(query, F.col("postings")), lambda k: F.struct(k.alias("key"), F.lit(number).alias("rule")))

    found = [named(n, q) for n, q in queries.items()]
    rows = blocks.select(F.explode(F.concat(*found)).alias("x")).select(F.col("x.key").alias("_found"), F.col("x.rule").alias("rule"))
    return rows.groupBy("_found").agg(F.collect_set("rule").alias("_rules"))


_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _spans(rules: tuple[Rule, ...], number: Column) -> Column:
    """start, kind (number), end of a rule's matches in _text: lengths of what lies between them, summed up."""
    text = F.col("_text")
    pattern, group, least = (F.get(F.array(*[F.lit(getattr(r, f)) for r in rules]), number) for f in ("pattern", "group", "at_least"))
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.zip_with(F.split(text, pattern, -1), match, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"))), F.regexp_extract_all(text, pattern, group), lambda s, c: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.length(c).alias("own")))

    def made(at: Column, s: Column) -> Column:
        own = F.array(F.struct((at + s["gap"]).alias("start"), number.alias("kind"), (at + s["gap"] + s["n"]).alias("end")))
        return F.when(s["own"] >= least, own.cast(_SPANS)).otherwise(F.array().cast(_SPANS))

    bound = F.get(F.transform(F.array(sizes), lambda x: placed(x, lambda s: s["gap"] + F.coalesce(s["n"], F.lit(0)), made, _SPANS)), F.lit(0))
    return F.when(F.rlike(text, pattern), bound).otherwise(F.array().cast(_SPANS))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row (the input row as a struct), _text and spans (array of start, kind's number, end; in order) of every row of docs(doc_id, text)."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), text_of().alias("_text"), F.xxhash64("doc_id", text_of()).alias("_key"))
    queries = {n: thinned(q) for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    index = build_index(rows.select("_key", "_text"), set().union(*map(_trigrams, queries.values())))
    named = stored(candidates(index, queries), "secret-candidates")
    maybe = possible(named, "_found")(F.col("_key"))
    none = F.array().cast("array<int>")
    hit = rows.filter(maybe)
    hit = hit.join(named, hit["_key"] == named["_found"], "left").select("_row", "_text", F.coalesce("_rules", none).alias("_rules"))
    joined = rows.filter(~maybe).select("_row", "_text", none.alias("_rules")).unionByName(hit)
    every = [n for n in range(len(rules)) if n not in queries]
    found = F.flatten(F.transform(F.concat("_rules", F.array(*[F.lit(n) for n in every]).cast("array<int>")), lambda n: _spans(rules, n)))
    # As a generator's output, which isn't repeated on both sides of the union.
    return joined.select("_row", "_text", F.inline(F.array(F.struct(F.array_sort(found).alias("spans")))))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(F.col("_row.doc_id").alias("doc_id"), *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.sha2(_written(base, rules).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced in text, and n_chars, if there, counted anew."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def merge(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (s["start"] < last["end"])
        longer = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    found = find(docs, rules).withColumn("_merged", F.aggregate("spans", none, lambda a, s: F.when(F.size(a) == 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(merge(a, s))))
    pieces = F.expr("transform(sequence(0, size(_merged)), i -> substring(_text, if(i = 0, 0, _merged[i - 1].end) + 1, if(i = size(_merged), length(_text), _merged[i].start) - if(i = 0, 0, _merged[i - 1].end)))")
    text = F.when(F.size("_merged") > 0, F.array_join(pieces, placeholder)).otherwise(F.col("_row.text"))
    changed = found.select("_row", text.alias("_new"))
    out = []
    for c in docs.columns:
        value = F.col(f"_row.`{c}`")
        if c == "text":
            value = F.col("_new")
        elif c == "n_chars":
            value = F.when(F.col("_new").isNull(), value).otherwise(F.length("_new").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return changed.select(*out)
