"""Text operators over the documents, pages, conversations and benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import text_stats as S
from ..sources import html
from .registry import query

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
OCC = f"(SELECT doc_id, unnest(tok) AS token, unnest(range(len(tok))) AS pos FROM (SELECT doc_id, {TOK} AS tok FROM documents))"


@query("t1_tokens", f"SELECT doc_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct, md5(array_to_string(tok, ' ')) AS digest FROM (SELECT doc_id, {TOK} AS tok FROM documents)")
def t1(read):
    t = F.col("tokens")
    return S.with_tokens(read("documents")).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.concat_ws(" ", t).cast("binary")).alias("digest"))


@query("t2_token_count", f"SELECT source, sum(len({TOK}))::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY source")
def t2(read):
    return read("documents").select("source", F.size(T.tokens(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


GRAMS3 = f"(SELECT doc_id, tok[i] || ' ' || tok[i+1] || ' ' || tok[i+2] AS g FROM (SELECT doc_id, tok, unnest(range(1, len(tok) - 1)) AS i FROM (SELECT doc_id, {TOK} AS tok FROM documents)))"


@query("t3_repeat_ratio", f"""
WITH c AS (SELECT doc_id, g, count(*) AS n FROM {GRAMS3} GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) AS grams, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS rep FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(s.grams, 0)::BIGINT AS grams, round(coalesce(s.rep / s.grams, 0.0), 6) AS repeat_ratio FROM documents d LEFT JOIN s USING (doc_id)""")
def t3(read):
    r = S.ngram_repeats(read("documents"), 3)
    return r.select("doc_id", F.col("grams").cast("long"), F.round(F.when(F.col("grams") > 0, F.col("repeated") / F.col("grams")).otherwise(0.0), 6).alias("repeat_ratio"))


@query("t4_surplus_ratio", f"""
WITH c AS (SELECT doc_id, g, count(*) AS n FROM {GRAMS3} GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) AS grams, sum(n - 1) AS rep FROM c GROUP BY 1)
SELECT d.doc_id, round(coalesce(s.rep / s.grams, 0.0), 6) AS surplus_ratio FROM documents d LEFT JOIN s USING (doc_id)""")
def t4(read):
    r = S.ngram_repeats(read("documents"), 3)
    return r.select("doc_id", F.round(F.when(F.col("grams") > 0, (F.col("grams") - F.col("distinct_grams")) / F.col("grams")).otherwise(0.0), 6).alias("surplus_ratio"))


@query("t5_window_diversity", f"""
WITH t AS (SELECT doc_id, pos, token, count(*) OVER (PARTITION BY doc_id) AS n FROM {OCC}),
w AS (SELECT doc_id, pos, n, len(list_distinct(list(token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))) AS d FROM t)
SELECT doc_id, round(CASE WHEN max(n) <= 50 THEN max(d)::DOUBLE / max(n) ELSE sum(d) FILTER (WHERE pos >= 49)::DOUBLE / (50 * count(*) FILTER (WHERE pos >= 49)) END, 6) AS diversity FROM w GROUP BY doc_id""")
def t5(read):
    return S.window_diversity(read("documents")).select("doc_id", F.round("diversity", 6).alias("diversity"))


@query("t6_compression_ratio")
def t6(read):
    return S.compression_ratio(read("documents")).select("doc_id", F.round("ratio", 6).alias("ratio"))


@query("t7_lexeme_kinds", r"""
WITH p AS (SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+')) AS t FROM documents) GROUP BY 1),
k AS (SELECT n, t, CASE WHEN regexp_full_match(t, '\s+') THEN 'ws' WHEN regexp_full_match(t, '\p{Nd}+') THEN 'number' WHEN regexp_full_match(t, '\p{P}+') THEN 'punct'
 WHEN regexp_full_match(t, '\p{S}+') THEN 'symbol' WHEN regexp_matches(t, '\p{L}') THEN 'word' WHEN regexp_matches(t, '\p{Nd}') THEN 'number' ELSE 'other' END AS kind, regexp_replace(t, '\P{L}+', '', 'g') AS letters FROM p),
f AS (SELECT kind, n, CASE WHEN kind = 'ws' THEN ' ' WHEN kind IN ('punct', 'symbol') THEN t ELSE replace(lower(t), 'ß', 'ss') END AS norm,
 CASE WHEN letters = '' THEN 0 WHEN regexp_full_match(letters, '\p{Lu}+') THEN 1 WHEN regexp_full_match(letters, '\p{Ll}+') THEN 2 WHEN regexp_full_match(letters, '\p{Lu}\p{Ll}+') THEN 4 ELSE 8 END
 + CASE WHEN kind = 'ws' THEN 0 ELSE CASE WHEN regexp_matches(t, '[^\x00-\x7F]') THEN 16 ELSE 0 END + CASE WHEN letters <> '' THEN 32 ELSE 0 END + CASE WHEN regexp_matches(t, '\p{Nd}') THEN 64 ELSE 0 END + CASE kind WHEN 'punct' THEN 128 WHEN 'symbol' THEN 256 ELSE 0 END END AS flags FROM k)
SELECT kind, flags, sum(n)::BIGINT AS n, count(DISTINCT norm) AS n_distinct FROM f GROUP BY 1, 2""")
def t7(read):
    """The test tables hold no character that NFKC changes; tests compare it by itself."""
    return S.lexemes(read("documents")).groupBy("kind", "flags").agg(F.sum("count").alias("n"), F.countDistinct("norm").alias("n_distinct"))


@query("t9_lexeme_occurrences", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, min(pos)::BIGINT AS least_pos FROM {OCC} GROUP BY token")
def t9(read):
    per_doc = S.occurrences(read("documents")).groupBy("token", "doc_id").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.min("p").cast("long").alias("least_pos"))


@query("t10_token_jaccard", """
WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS s, lag(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) OVER (ORDER BY item_id) AS p FROM benchmark)
SELECT item_id, round(len(list_intersect(s, p))::DOUBLE / len(list_distinct(list_concat(s, p))), 6) AS jaccard FROM b WHERE p IS NOT NULL""")
def t10(read):
    """Each benchmark item against the one before it: joined by number, not by a window over all rows."""
    b = read("benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    ids = b.select("item_id")
    before = ids.alias("a").join(ids.alias("b"), F.col("a.item_id") == F.col("b.item_id") + 1).select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("prev"))
    p = b.select(F.col("item_id").alias("prev"), F.col("s").alias("p"))
    return b.join(before, "item_id").join(p, "prev").select("item_id", F.round(T.jaccard(F.col("s"), F.col("p")), 6).alias("jaccard"))


@query("t11_simhash", f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(token), 17, 16))::UBIGINT AS h FROM {OCC}),
b AS (SELECT doc_id, i, sum(((h >> i) & 1)::INT) AS ones, count(*) AS n FROM h, range(64) r(i) GROUP BY 1, 2),
f AS (SELECT doc_id, sum(CASE WHEN 2 * ones >= n THEN (1::HUGEINT << i::HUGEINT) ELSE 0 END)::UBIGINT AS f FROM b GROUP BY 1)
SELECT d.doc_id, lpad(lower(hex(coalesce(f, 18446744073709551615::UBIGINT))), 16, '0') AS simhash FROM documents d LEFT JOIN f USING (doc_id)""")
def t11(read):
    return S.simhash(read("documents")).select("doc_id", "simhash")


@query("t12_hamming", "SELECT a.user_id, sum(bit_count(xor(a.event_id, b.event_id)))::BIGINT AS bits FROM events a JOIN events b ON a.event_id + 1 = b.event_id GROUP BY a.user_id")
def t12(read):
    e = read("events").select("event_id", "user_id")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_id").alias("next"))
    return e.join(b, "event_id").groupBy("user_id").agg(F.sum(T.hamming(F.col("event_id"), F.col("next"))).cast("long").alias("bits"))




_MINS = ", ".join(f"min(substr(sha1('{i}-' || token), 1, 16)) AS m{i}" for i in range(8))


@query("t13_minhash", f"SELECT d.doc_id, {', '.join(f"coalesce(m{i}, repeat('0', 16)) AS m{i}" for i in range(8))} FROM documents d LEFT JOIN (SELECT doc_id, {_MINS} FROM (SELECT DISTINCT doc_id, token FROM {OCC}) GROUP BY doc_id) USING (doc_id)")
def t13(read):
    rows = S.with_tokens(read("documents")).select("doc_id", F.array_distinct("tokens").alias("t"))
    return rows.select("doc_id", *[T.minhash(F.col("t"), i).alias(f"m{i}") for i in range(8)])


@query("t15_canonical_tokens", """
WITH w AS (SELECT doc_id, regexp_extract_all(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ſ', 's'), '[a-z0-9'']+') AS w FROM documents),
u AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 2 AND x NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'had', 'has', 'have', 'he', 'her', 'hers', 'him', 'his', 'i', 'in', 'into', 'is', 'it', 'its', 'of', 'on', 'or', 'she', 'that', 'the', 'their', 'them', 'there', 'they', 'this', 'to', 'was', 'were', 'with', 'you', 'your')),
 lambda x: CASE WHEN regexp_full_match(x, 'emphasis(e|ed|es|ing)|organisations?') THEN replace(replace(x, 'emphasis', 'emphasiz'), 'organisation', 'organization') ELSE x END))) AS s FROM w)
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, ' ')) AS digest FROM u""")
def t15(read):
    s = T.canonical_tokens(F.col("text"))
    return read("documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.concat_ws(" ", "s").cast("binary")).alias("digest"))


@query("t16_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n_sentences FROM documents")
def t16(read):
    return read("documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("t18_phrase_spans", f"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark),
p AS (SELECT item_id, least(4, len(w)) AS n, array_to_string(w[i:i+least(4, len(w))-1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
q AS (SELECT min(item_id) AS phrase_id, n, g FROM p GROUP BY 2, 3),
d AS (SELECT doc_id, n, i - 1 AS start, array_to_string(tok[i:i+n-1], ' ') AS g FROM (SELECT doc_id, tok, n, unnest(range(1, len(tok) - n + 2)) AS i FROM (SELECT doc_id, {TOK} AS tok FROM documents), (SELECT DISTINCT n FROM q)))
SELECT doc_id, phrase_id, start::BIGINT AS start, (start + n)::BIGINT AS "end" FROM d JOIN q USING (n, g)""")
def t18(read):
    """Every phrase of four words of every item (all words of a shorter one), under the smallest id of an item that has it."""
    words = read("benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    every = words.select("item_id", F.explode(F.when(F.size("w") > 4, T.ngrams(F.col("w"), 4)).otherwise(F.array(F.concat_ws(" ", "w")))).alias("phrase"))
    phrases = every.groupBy("phrase").agg(F.min("item_id").alias("phrase_id"))
    return S.phrase_spans(read("documents"), phrases).select("doc_id", "phrase_id", F.col("start").cast("long"), F.col("end").cast("long"))


@query("t19_cues", f"SELECT doc_id, list_contains({TOK}, 'and') AS has_and, contains(lower(text), 'of the') AS has_of_the FROM documents")
def t19(read):
    d = read("documents").select("doc_id", "text", T.tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", T.has_cue(F.col("text"), F.col("tokens"), "and").alias("has_and"), T.has_cue(F.col("text"), F.col("tokens"), "of the").alias("has_of_the"))


@query("t22_citations", r"""
WITH c AS (SELECT o_orderkey AS doc_id, 'See [' || strftime(o_orderdate, '%Y') || '] ORD ' || (o_custkey % 100)::VARCHAR || ' and Order ' || o_orderkey::VARCHAR || '.' AS text FROM orders),
x AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\d{4}\]\s+[A-Z][A-Z0-9]+\s+\d+')) AS citation FROM c)
SELECT citation, count(*) AS n, min(doc_id) AS first_doc FROM x GROUP BY citation""")
def t22(read):
    o = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("See ["), F.date_format("o_orderdate", "yyyy"), F.lit("] ORD "), (F.col("o_custkey") % 100).cast("string"), F.lit(" and Order "), F.col("o_orderkey").cast("string"), F.lit(".")).alias("text"))
    return o.select("doc_id", F.explode(T.citations(F.col("text"))).alias("citation")).groupBy("citation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("t24_speakers", r"""
WITH m AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations),
p AS (SELECT conv_id, turn, regexp_extract(line, '^([a-z]+): ', 1) AS speaker, line FROM m)
SELECT conv_id, turn::BIGINT AS turn, CASE WHEN speaker IN ('user', 'assistant') THEN speaker END AS speaker,
 CASE WHEN speaker IN ('user', 'assistant') THEN 0.9 WHEN speaker <> '' THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN speaker IN ('user', 'assistant') THEN 'header' WHEN speaker <> '' THEN 'unknown_name' ELSE 'no_header' END AS reason, (speaker NOT IN ('user', 'assistant')) AS abstained FROM p""")
def t24(read):
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    speaker = F.regexp_extract(line, r"^([a-z]+): ", 1)
    known = speaker.isin("user", "assistant")
    return read("conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(known, speaker).alias("speaker"),
        F.when(known, 0.9).when(speaker != "", 0.4).otherwise(0.0).alias("confidence"),
        F.when(known, "header").when(speaker != "", "unknown_name").otherwise("no_header").alias("reason"), (~known).alias("abstained"),
    )


@query("t26_numeric_keys", """
WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS k, (o_orderkey % 900 + 1) AS v FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN regexp_replace(regexp_replace(format('{:e}', v * 1e6), '\\.?0*e', 'e'), 'e\\+0*', 'e') || '|usd' WHEN 1 THEN v || '|percent' WHEN 2 THEN v || '|' WHEN 3 THEN v || '|thousand' WHEN 4 THEN '-' || v || '.5|year'
 WHEN 5 THEN '' WHEN 6 THEN regexp_replace(regexp_replace(format('{:e}', v * 1e3), '\\.?0*e', 'e'), 'e\\+0*', 'e') || '|aud' ELSE '' END AS num_key FROM x""")
def t26(read):
    v = (F.col("o_orderkey") % 900 + 1).cast("string")
    forms = F.array(F.concat(F.lit("$"), v, F.lit(" million")), F.concat(v, F.lit(" per  cent")), F.concat(F.lit("00"), v, F.lit(".0")), F.concat(v, F.lit("thousand")), F.concat(F.lit("-"), v, F.lit(".50 Years")), F.concat(v, F.lit(" year day")), F.concat(F.lit("A$ "), v, F.lit(" thousand")), F.concat(v, F.lit(" apples")))
    return read("orders").select("o_orderkey", T.numeric_key(F.get(forms, (F.col("o_orderkey") % 8).cast("int"))).alias("num_key"))


@query("t27_revision_diff")
def t27(read):
    d = read("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("old"), F.regexp_replace("text", r"\.\n", ".\n\n").alias("new"))
    return S.line_diff(d)


@query("t28_fuzzy_labels")
def t28(read):
    return S.fuzzy_labels(read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "small ring", 0.7, 20)


@query("t29_repeated_phrases", f"SELECT g AS phrase, count(*) AS count, count(DISTINCT doc_id) AS docs FROM {GRAMS3} GROUP BY g HAVING count(*) >= 5")
def t29(read):
    return S.repeated_phrases(read("documents"), 3, 5)


@query("t30_concept_cloud", f"SELECT token, count(*) AS n FROM {OCC} WHERE length(token) >= 4 GROUP BY token ORDER BY n DESC, token LIMIT 50")
def t30(read):
    return S.occurrences(read("documents")).filter(F.length("token") >= 4).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query("t32_modality", r"""
WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'The carrier must not release goods' WHEN 1 THEN 'The buyer shall pay' WHEN 2 THEN 'The seller may cancel' WHEN 3 THEN 'Goods are stored' WHEN 4 THEN 'This part does not apply to gifts and must be read so' ELSE 'A buyer may not resell' END AS clause FROM orders),
m AS (SELECT id, regexp_extract(lower(clause), '\b(does not apply|except|must not|shall not|may not|must|shall|may)\b', 1) AS f FROM c)
SELECT CASE WHEN f IN ('does not apply', 'except') THEN 'exclusion' WHEN f IN ('must not', 'shall not', 'may not') THEN 'prohibition' WHEN f IN ('must', 'shall') THEN 'obligation' ELSE 'permission' END AS modality, count(*) AS n FROM m WHERE f <> '' GROUP BY 1""")
def t32(read):
    clauses = ("The carrier must not release goods", "The buyer shall pay", "The seller may cancel", "Goods are stored", "This part does not apply to gifts and must be read so", "A buyer may not resell")
    clause = F.get(F.array(*[F.lit(c) for c in clauses]), (F.col("o_orderkey") % 6).cast("int"))
    return read("orders").select(T.modality(clause).alias("modality")).filter("modality is not null").groupBy("modality").agg(F.count("*").alias("n"))


@query("t25_language_votes", f"""
WITH v AS (SELECT doc_id, token, CASE WHEN token IN ('the', 'and', 'of', 'is', 'to') THEN 'en' WHEN token IN ('der', 'die', 'und', 'das', 'ist') THEN 'de' WHEN token IN ('le', 'la', 'et', 'les', 'un') THEN 'fr' WHEN token IN ('el', 'los', 'que', 'y', 'del') THEN 'es' END AS l FROM {OCC}),
c AS (SELECT doc_id, l, count(*) AS n FROM v WHERE l IS NOT NULL GROUP BY 1, 2),
w AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, l) AS r FROM c)
SELECT d.lang, coalesce(w.l, 'none') AS voted, count(*) AS n FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id AND r = 1 GROUP BY 1, 2""")
def t25(read):
    """Stop-word votes against the stored language, counted in the row."""
    votes = {"en": ("the", "and", "of", "is", "to"), "de": ("der", "die", "und", "das", "ist"), "fr": ("le", "la", "et", "les", "un"), "es": ("el", "los", "que", "y", "del")}
    rows = read("documents").select("lang", T.tokens(F.col("text")).alias("t"))

    def count(words):
        return F.size(F.filter("t", lambda w: w.isin(*words)))

    named = [F.struct((-count(w)).alias("n"), F.lit(k).alias("l")) for k, w in sorted(votes.items())]
    best = F.array_min(F.array(*named))
    return rows.select("lang", best.alias("b")).select("lang", F.when(F.col("b.n") < 0, F.col("b.l")).otherwise("none").alias("voted")).groupBy("lang", "voted").agg(F.count("*").alias("n"))


@query("s4_html_text_parsed")
def s4b(read):
    return html.parsed(read("pages"))


@query("s4_html_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<template\b[^>]*>.*?</template\s*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|nav)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))) AS digest FROM d""")
def s4(read):
    return read("pages").select("page_id", F.md5(html.stripped(F.col("html")).cast("binary")).alias("digest"))


@query("s6_links", r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
a AS (SELECT page_id, origin, regexp_replace(CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN origin || href ELSE origin || '/' || href END, '#.*$', '') AS target FROM l WHERE href <> '' AND NOT starts_with(href, '#'))
SELECT DISTINCT page_id, target, regexp_extract(target, '^([a-z]+://[^/?#]+)', 1) = origin AS same_host FROM a""")
def s6(read):
    return html.links(read("pages"))


@query("s14_source_manifest", "SELECT source AS family, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS n_content FROM documents GROUP BY source")
def s14(read):
    return read("documents").select("source", F.octet_length("text").alias("b"), F.sha2(F.col("text").cast("binary"), 256).alias("h")).groupBy(F.col("source").alias("family")).agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.countDistinct("h").alias("n_content"))


@query("s11_text_units", """
WITH u AS (SELECT 'document:' || doc_id AS unit_id, source AS source_id, 'document' AS source_type, text FROM documents
 UNION ALL SELECT 'turn:' || turn, conv_id::VARCHAR, 'turn', text FROM conversations UNION ALL SELECT 'item:' || item_id, item_id::VARCHAR, 'item', text FROM benchmark)
SELECT source_type, count(*) AS units, count(DISTINCT source_id) AS sources, sum(length(text))::BIGINT AS chars FROM u GROUP BY source_type""")
def s11(read):
    from ..sources.tables import text_units

    units = text_units((read("documents"), "document", "doc_id", "source", "text"), (read("conversations"), "turn", "turn", "conv_id", "text"), (read("benchmark"), "item", "item_id", "item_id", "text"))
    return units.groupBy("source_type").agg(F.count("*").alias("units"), F.countDistinct("source_id").alias("sources"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("w10_w13_nearest_turn", """
SELECT conv_id, turn::BIGINT AS turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS last_user_turn FROM conversations""")
def w13(read):
    """Recency: the nearest user turn before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return read("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).cast("long").alias("last_user_turn"))


@query("source_profile", f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(token), 17, 16))::UBIGINT AS h FROM {OCC}), b AS (SELECT doc_id, i, sum(((h >> i) & 1)::INT) AS ones, count(*) AS n FROM h, range(64) r(i) GROUP BY 1, 2),
f AS (SELECT doc_id, sum(CASE WHEN 2 * ones >= n THEN (1::HUGEINT << i::HUGEINT) ELSE 0 END) AS f FROM b GROUP BY 1)
SELECT source, count(*) AS docs, sum(len({TOK}))::BIGINT AS tokens, count(DISTINCT coalesce(f, 18446744073709551615)) AS fingerprints FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1""")
def source_profile(read):
    """Documents, tokens and distinct fingerprints of each source."""
    d = S.simhash(read("documents"), "doc_id", "source")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.countDistinct("simhash").alias("fingerprints"))
