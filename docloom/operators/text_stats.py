"""Statistics of tokenised text, one pass over exploded tokens or none at all."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def with_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, T.tokens(F.col(text)).alias("tokens"))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, token of every token."""
    return with_tokens(docs, key, text).select(key, F.posexplode("tokens").alias("pos", "token"))


def ngram_repeats(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """key, grams, distinct_grams, repeated (occurrences of n-grams seen twice or more).

    Counted in the row itself: sorted hashes next to an equal one are repeats, so nothing is shuffled."""
    rows = with_tokens(docs, key).select(key, T.ngrams(F.col("tokens"), n).alias("grams"))
    rows = rows.select(key, "grams", F.size("grams").alias("n"), F.size(F.array_distinct("grams")).alias("d"))
    rows = rows.withColumn("s", F.when(F.col("d") < F.col("n"), F.sort_array("grams")).otherwise(F.array().cast("array<string>")))
    again = F.size(F.filter(F.transform("s", lambda g, i: (F.get(F.col("s"), i - 1).eqNullSafe(g) | F.get(F.col("s"), i + 1).eqNullSafe(g))), lambda x: x))
    return rows.select(key, F.col("n").alias("grams"), F.col("d").alias("distinct_grams"), again.alias("repeated"))


def window_diversity(docs: DataFrame, width: int = 50, key: str = "doc_id") -> DataFrame:
    """key, diversity: distinct share of each full window of width tokens, averaged; of shorter texts, of all their tokens. Texts without tokens are left out.

    A token counts once in the windows that hold it and start after its previous occurrence. Within the
    row: tokens and places are sorted together, so each stands next to the one before it, and nothing is
    shuffled."""
    rows = with_tokens(docs, key).select(key, F.size("tokens").alias("n"), F.array_sort(F.transform("tokens", lambda t, i: F.struct(F.xxhash64(t).alias("t"), i.alias("i")))).alias("s"))
    # -1 where a token has no previous occurrence, else its place.
    before = F.transform("s", lambda x, j: F.struct(x["i"].alias("i"), F.when(F.get(F.col("s"), j - 1)["t"] == x["t"], F.get(F.col("s"), j - 1)["i"]).otherwise(-1).alias("b")))
    rows = rows.withColumn("g", before)
    n = F.col("n")

    def windows(x):
        first = F.greatest(x["b"] + 1, x["i"] - width + 1, F.lit(0))
        return F.greatest(F.lit(0), F.least(x["i"], n - width) - first + 1).cast("long")

    zero = F.lit(0).cast("long")
    long = F.aggregate("g", zero, lambda a, x: a + windows(x)) / ((n - width + 1) * width)
    short = F.size(F.filter("g", lambda x: x["b"] < 0)) / n
    return rows.filter(n > 0).select(key, F.when(n > width, long).otherwise(short).alias("diversity"))


def _narrow_counts(hashes):
    """How often each bit is set, in blocks of 127 hashes: of a block eight longs c0 to c7, whose byte b counts bit 8 b + k.

    Eight bits are counted by one addition; a byte can't overflow within a block."""
    zero, bytes_ = F.lit(0).cast("long"), F.lit(0x0101010101010101).cast("long")

    def add(a, x):
        return F.struct(*[(a[f"c{k}"] + F.call_function("shiftrightunsigned", x, F.lit(k)).bitwiseAND(bytes_)).alias(f"c{k}") for k in range(8)])

    def counted(b):
        return F.aggregate(F.slice(hashes, b * 127 + 1, 127), F.struct(*[zero.alias(f"c{k}") for k in range(8)]), add)

    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(hashes) - 1) / 127)).cast("int")), counted)


def simhash(docs: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """key, the columns keep, tokens' number n_tokens and simhash: 64 bits as a string of 16 hex digits, each 1 if at least half of the tokens' hashes have it; all ones for no tokens."""
    rows = docs.select(key, *keep, T.tokens(F.col("text")).alias("tokens"))
    rows = rows.select(key, *keep, F.size("tokens").alias("n_tokens"), T.simhash_bits(F.col("tokens")).alias("_h"))
    narrow = _narrow_counts(F.col("_h"))
    rows = rows.withColumn("_narrow", narrow)
    zero = F.lit(0).cast("long")

    def ones(bit: int):
        return F.aggregate("_narrow", zero, lambda a, c: a + F.call_function("shiftrightunsigned", c[f"c{bit % 8}"], F.lit(8 * (bit // 8))).bitwiseAND(255))

    rows = rows.withColumn("_ones", F.array(*[ones(i) for i in range(64)]))
    word = F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda a, i: a.bitwiseOR(F.when(2 * F.get(F.col("_ones"), i) >= F.col("n_tokens"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)))
    # As a generator's output, so that no filter is moved, with copies of the whole expression, below the counters.
    return rows.select(key, *keep, "n_tokens", F.inline(F.array(F.struct(F.lower(F.lpad(F.hex(word), 16, "0")).alias("simhash")))))


def compression_ratio(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ratio of zlib size to size; 1.0 for empty texts. There is no such function in Spark, so Arrow batches go to Python."""

    @F.pandas_udf("double")
    def ratio(text):
        return text.map(lambda t: 1.0 if not t else len(zlib.compress(t.encode())) / len(t.encode()))

    return docs.select(key, ratio(F.coalesce("text", F.lit(""))).alias("ratio"))


def lexemes(docs: DataFrame, pattern: str = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+") -> DataFrame:
    """surface, norm, kind, flags, count of the tokens of docs(text). Only distinct surfaces are normalised (NFKC has no form in Spark, so they go to Python in Arrow batches)."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(x):
        return x.map(lambda t: unicodedata.normalize("NFKC", t))

    counted = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("surface")).groupBy("surface").count()
    # ASCII is its own normal form.
    plain, other = counted.filter(~F.col("surface").rlike(r"[^\x00-\x7F]")), counted.filter(F.col("surface").rlike(r"[^\x00-\x7F]"))
    rows = plain.withColumn("_n", F.col("surface")).unionByName(other.withColumn("_n", nfkc("surface")))
    return rows.select("surface", T.lexeme_norm(F.col("_n")).alias("norm"), T.lexeme_kind(F.col("_n")).alias("kind"), T.lexeme_flags(F.col("surface"), F.col("_n")).alias("flags"), "count")


#: Phrases that concept_spans() holds in every task, at most.
MAX_CONCEPTS = 200_000


def concept_spans(docs: DataFrame, concepts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, concept_id, start, end of every occurrence, overlapping ones included, of concepts(concept_id, phrase) in docs(key, text).

    Phrases are substrings of the lower-case text, not words; places are characters. One automaton of all
    phrases, of a bounded number, reads each text once. Empty and null phrases match nothing."""
    spec = docs.schema[key].dataType.simpleString()
    rows = concepts.select(F.col("concept_id").cast("string").alias("c"), F.lower("phrase").alias("p")).filter("p <> ''").distinct().limit(MAX_CONCEPTS + 1).collect()
    if len(rows) > MAX_CONCEPTS:
        raise ValueError(f"more than {MAX_CONCEPTS} phrases")
    by_phrase: dict[str, list[str]] = {}
    for r in rows:
        by_phrase.setdefault(r.p, []).append(r.c)

    def run(batches):
        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        for phrase, ids in by_phrase.items():
            automaton.add_word(phrase, (len(phrase), sorted(ids)))
        if by_phrase:
            automaton.make_automaton()
        for pdf in batches:
            found = [(k, c, end + 1 - n, end + 1) for k, t in zip(pdf[key], pdf["_low"], strict=True) for end, (n, ids) in (automaton.iter(t) if by_phrase else ()) for c in ids]
            yield pd.DataFrame(found, columns=[key, "concept_id", "start", "end"])

    return docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("_low")).mapInPandas(run, f"{key} {spec}, concept_id string, start long, end long")


def repeated_labels(spans: DataFrame, by: str, label: str, start: str, least: int = 3, gap: int = 200) -> DataFrame:
    """by, label, kept: labels with at least so many occurrences of which each is gap characters or more after the last one kept.

    Taken greedily from the left, over the sorted places of each label."""
    places = spans.filter(F.col(label) != "").groupBy(by, label).agg(F.array_sort(F.collect_list(F.col(start).cast("long"))).alias("_p"))
    kept = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last")), lambda a, p: F.when(a["last"].isNull() | (p - a["last"] >= gap), F.struct((a["n"] + 1).alias("n"), p.alias("last"))).otherwise(a), lambda a: a["n"])
    return places.select(by, label, kept.alias("kept")).filter(F.col("kept") >= least)


def repeated_phrases(docs: DataFrame, n: int = 3, least: int = 3, key: str = "doc_id") -> DataFrame:
    """phrase, count, docs of n-grams that occur often enough; counts are combined before the shuffle."""
    grams = with_tokens(docs, key).select(key, F.explode(T.ngrams(F.col("tokens"), n)).alias("phrase"))
    per_doc = grams.groupBy("phrase", key).count()
    return per_doc.groupBy("phrase").agg(F.sum("count").alias("count"), F.count("*").alias("docs")).filter(F.col("count") >= least)


def phrase_spans(docs: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, phrase_id, start, end of every occurrence of phrases(phrase_id, phrase) as consecutive tokens, overlapping ones included.

    Phrases of each length are joined on a hash of as many consecutive tokens; the lengths are a handful."""
    split = phrases.select("phrase_id", T.tokens(F.col("phrase")).alias("w")).filter(F.size("w") > 0).select("phrase_id", F.size("w").alias("len"), F.concat_ws(" ", "w").alias("gram"))
    lengths = sorted(r.len for r in split.select("len").distinct().limit(65).collect())
    if len(lengths) > 64:
        raise ValueError("phrases of more than 64 lengths")
    words, out = with_tokens(docs, key), None
    for n in lengths:
        grams = words.select(key, F.posexplode(T.ngrams(F.col("tokens"), n)).alias("start", "gram"))
        found = grams.join(split.filter(F.col("len") == n), "gram").select(key, "phrase_id", "start", (F.col("start") + n).alias("end"))
        out = found if out is None else out.unionByName(found)
    return out


def fuzzy_labels(labels: DataFrame, needle: str, threshold: float = 0.6, k: int = 10) -> DataFrame:
    """The k labels(id, label) most alike to a needle by the matching-blocks ratio, at or above a threshold."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(label):
        return label.map(lambda x: SequenceMatcher(None, needle.lower(), (x or "").lower()).ratio())

    return labels.withColumn("score", F.round(ratio("label"), 6)).filter(F.col("score") >= threshold).orderBy(F.desc("score"), "label", "id").limit(k)


def line_diff(pairs: DataFrame) -> DataFrame:
    """key, added, removed lines between pairs(key, old, new), as a unified diff counts them."""
    import pandas as pd

    @F.pandas_udf("added long, removed long")
    def count(old, new):
        from difflib import unified_diff

        out = []
        for a, b in zip(old.fillna(""), new.fillna(""), strict=True):
            body = [x for x in unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=0)][2:]
            out.append((sum(x[:1] == "+" for x in body), sum(x[:1] == "-" for x in body)))
        return pd.DataFrame(out, columns=["added", "removed"])

    return pairs.select("key", count("old", "new").alias("d")).select("key", "d.added", "d.removed")


def obligations(docs: DataFrame, key: str) -> DataFrame:
    """key, clause, modality, surface, actor, action, object of the clauses of docs(key, text) that hold a modal phrase; what a clause lacks is null.

    The actor is what stands before the phrase, without numbers, marks and words that can't begin one; the
    action is the word after it (and after "to"), the object what follows up to a preposition of place or time."""
    rows = docs.select(key, F.posexplode(T.clauses(F.col("text"))).alias("clause", "_w"))
    rows = rows.withColumn("_n", F.transform("_w", T.plain_word)).withColumn("_m", T.modal_of(F.col("_n"))).filter("_m is not null")
    words, at, after = F.col("_n"), F.col("_m.at"), F.col("_m.at") + F.col("_m.n")
    numbered = r"^(?:[0-9]+|[().]+|[a-z]|\([a-z]\))$"
    before = F.filter(F.slice(words, 1, at), lambda w: (w != "") & ~w.rlike(numbered))
    rows = rows.withColumn("_b", before)
    noise = lambda w: w.isin(*T.ACTOR_PREFIXES) | w.rlike(r"^(?:[0-9]+|[0-9]+\.[0-9]+|[().,;:\[\]]+)$")
    first = F.array_min(F.filter(F.transform("_b", lambda w, i: F.when(~noise(w), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_a", F.when(first.isNotNull(), F.slice("_b", first + 1, F.size("_b"))).otherwise(F.col("_b")))
    meant = F.exists("_a", lambda w: w.rlike(r"\p{L}") & (F.length(w) >= 2) & ~w.isin(*T.ACTOR_NOISE))
    rest = F.slice(words, after + 1, F.size(words))
    rows = rows.withColumn("_r", rest).withColumn("_r", F.when(F.get("_r", F.lit(0)) == "to", F.slice("_r", 2, F.size("_r"))).otherwise(F.col("_r")))
    tail = F.slice("_r", 2, F.size("_r"))
    rows = rows.withColumn("_t", F.when(F.size("_r") > 1, tail).otherwise(F.array().cast("array<string>")))
    end = F.array_min(F.filter(F.transform("_t", lambda w, i: F.when(w.isin(*T.OBJECT_ENDS), i)), lambda i: i.isNotNull()))
    thing = F.array_join(F.filter(F.slice("_t", 1, F.coalesce(end, F.size("_t"))), lambda w: w != ""), " ")
    return rows.select(
        key, "clause", F.col("_m.kind").alias("modality"), F.col("_m.surface").alias("surface"), F.when(meant, F.array_join("_a", " ")).alias("actor"),
        F.when(F.size("_r") > 0, F.get("_r", F.lit(0))).alias("action"), F.when(thing != "", thing).alias("object"),
    )


def citation_resolution(docs: DataFrame, known, key: str = "doc_id") -> DataFrame:
    """key, citation, pos, reason of every neutral citation of docs(key, text), with its place in characters.

    already_ingested where a document of a smaller key has it; else resolved or unresolved by known(citation)."""
    pattern = r"\[\d{4}\]\s+[A-Z][A-Z0-9]+\s+\d+"
    rows = docs.select(key, F.split("text", pattern, -1).alias("_g"), T.citations(F.col("text")).alias("_c"))
    places = F.transform("_c", lambda c, i: F.struct(c.alias("citation"), (F.aggregate(F.slice("_g", 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("_c", 1, i), F.lit(0), lambda a, x: a + F.length(x))).cast("long").alias("pos")))
    found = rows.select(key, F.explode(places).alias("x")).select(key, "x.*")
    first = found.groupBy("citation").agg(F.min(key).alias("_first"))
    reason = F.when(F.col(key) != F.col("_first"), "already_ingested").when(known(F.col("citation")), "resolved").otherwise("unresolved")
    return found.join(first, "citation").select(key, "citation", "pos", reason.alias("reason"))
