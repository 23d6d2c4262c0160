"""Column builders over text: tokens, n-grams, normal forms, fingerprints. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Words that the canonical token set leaves out, and the spellings that it unites.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "i", "in", "into", "is", "it", "its", "of", "on", "or", "she", "that", "the", "their", "them",
    "there", "they", "this", "to", "was", "were", "with", "you", "your",
)
SPELLINGS = {"emphasise": "emphasize", "emphasised": "emphasized", "emphasises": "emphasizes", "emphasising": "emphasizing", "organisation": "organization", "organisations": "organizations"}
#: Characters that full case folding turns into others than lower case does (Latin, Greek).
FOLDS = {"ß": "ss", "ſ": "s", "ŉ": "ʼn", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def casefold(text: Column) -> Column:
    """Lower case with the full foldings of Latin and Greek."""
    out = F.lower(text)
    for old, new in FOLDS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Every n consecutive words, joined by a space. Elements are read in place, so long texts stay linear."""
    gram = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), gram)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets are alike (1.0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def canonical_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The set of ASCII words of two characters or more after case folding, without stop words, spellings united, in order."""
    words = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    kept = F.array_except(F.filter(words, lambda w: F.length(w) >= 2), F.array(*[F.lit(w) for w in stop_words]))

    def united(w: Column) -> Column:
        return F.coalesce(*[F.when(w == old, F.lit(new)) for old, new in SPELLINGS.items()], w)

    return F.array_sort(F.array_distinct(F.transform(kept, united)))


def without_enumeration(text: Column) -> Column:
    """A text without a leading number such as 1, 2.3 or 4-5), trimmed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\d+(?:[-.]\d+)*+[.)]?\s*", ""), r"^\s+|\s+$", "")


def lexeme_kind(token: Column) -> Column:
    """other, ws, number, punct, symbol or word, by what all characters of a token are; mixed ones by any letter, then any digit."""
    return (
        F.when(token == "", "other")
        .when(token.rlike(r"^\s+$"), "ws")
        .when(token.rlike(r"^\p{Nd}+$"), "number")
        .when(token.rlike(r"^\p{P}+$"), "punct")
        .when(token.rlike(r"^\p{S}+$"), "symbol")
        .when(token.rlike(r"\p{L}"), "word")
        .when(token.rlike(r"\p{Nd}"), "number")
        .otherwise("other")
    )


def lexeme_norm(token: Column) -> Column:
    """The normal form of a token that is NFKC already: white space is one space, marks stay, the rest is folded."""
    kind = lexeme_kind(token)
    return F.when(kind == "ws", " ").when(kind.isin("punct", "symbol"), token).otherwise(casefold(token))


#: Bits of a token's flags.
ALL_UPPER, ALL_LOWER, TITLE, MIXED_CASE, NON_ASCII, HAS_LETTER, HAS_DIGIT, HAS_PUNCT, HAS_SYMBOL, REPLACEMENT, ZERO_WIDTH = (1 << n for n in range(11))


def lexeme_flags(surface: Column, normal: Column) -> Column:
    """The flags of a token: letter case from its surface, the others from its NFKC form; none of the latter for white space."""
    letters = F.regexp_replace(surface, r"\P{L}+", "")
    case = F.when(letters == "", 0).when(letters.rlike(r"^\p{Lu}+$"), ALL_UPPER).when(letters.rlike(r"^\p{Ll}+$"), ALL_LOWER).when(letters.rlike(r"^\p{Lu}\p{Ll}+$"), TITLE).otherwise(MIXED_CASE)
    kind = lexeme_kind(normal)
    tests = ((NON_ASCII, normal.rlike(r"[^\x00-\x7F]")), (REPLACEMENT, normal.contains("\ufffd")), (ZERO_WIDTH, normal.rlike("[\u200b\u200c\u200d\ufeff]")), (HAS_LETTER, normal.rlike(r"\p{L}")), (HAS_DIGIT, normal.rlike(r"\p{Nd}")), (HAS_PUNCT, kind == "punct"), (HAS_SYMBOL, kind == "symbol"))
    content = sum((F.when(test, bit).otherwise(0) for bit, test in tests), F.lit(0))
    return case + F.when(kind.isin("ws") | (normal == ""), 0).otherwise(content)


def sentences(text: Column) -> Column:
    """Parts of a text after . ! or ? and white space, without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")


def simhash_bits(tokens_: Column) -> Column:
    """The low 64 bits of each token's MD5, as longs; a bit of the SimHash is 1 if at least half of them have it."""
    return F.transform(tokens_, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 17, 16), 16, -10).cast("long"))


def minhash(tokens_: Column, i: int) -> Column:
    """The smallest first 64 bits of SHA-1 over "i-token", as hex; zeros where there is no token."""
    return F.coalesce(F.array_min(F.transform(tokens_, lambda t: F.substring(F.sha1(F.concat(F.lit(f"{i}-"), t).cast("binary")), 1, 16))), F.lit("0" * 16))


def has_cue(text: Column, words: Column, cue: str) -> Column:
    """A one-word cue must be among the words; one of several words must be in the text, in any letter case."""
    if any(c in cue for c in r"\[](){}*+?|^$"):
        raise ValueError(f"cues are literal: {cue!r}")
    return F.contains(F.lower(text), F.lit(cue.lower())) if " " in cue else F.array_contains(words, cue.lower())


def citations(text: Column) -> Column:
    """Neutral citations such as [2020] ABC 12."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\d{4}\]\s+[A-Z][A-Z0-9]+\s+\d+"), F.lit(0))


#: Scales, currencies and units of numeric mentions.
SCALES = {"hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12}
CURRENCIES = {"us$": "usd", "a$": "aud", "$": "usd", "€": "eur", "£": "gbp"}
CODES = ("usd", "aud", "eur", "gbp")
UNITS = ("percent", *SCALES, "year", "month", "day", "line", "point", *CODES)
UNIT_WORDS = {"%": "percent", "percentage": "percent", "dollar": "usd", "dollars": "usd", "years": "year", "months": "month", "days": "day", "lines": "line", "points": "point"}


def numeric_key(surface: Column) -> Column:
    """value|unit of a numeric mention, empty where there is no value or its units don't go together.

    No unit, one unit, or a currency with a scale; the latter's value is scaled, as mantissa and exponent."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(surface, F.lit("")), r"\s+", " ")))
    return let(F.regexp_replace(low, "(^| )per cent(?= |$)", "$1percent"), _numeric_key)


def _numeric_key(low: Column) -> Column:
    sign = F.regexp_extract(low, r"^(us\$|a\$|\$|€|£|(?:usd|aud|eur|gbp)(?= ))", 1)
    # A single word may hold its unit: 5million, 3%.
    rest = F.regexp_replace(F.trim(F.substring(low, F.length(sign) + 1, F.length(low))), rf"^([+-]?(?=[.,]*[0-9])[0-9,]*(?:\.[0-9,]*)?)({'|'.join(UNITS)})$", "$1 $2")
    return let(F.struct(sign.alias("sign"), F.split(rest, " ").alias("words")), lambda p: let(F.struct(_value_of(F.get(p["words"], F.lit(0))).alias("value"), _units_of(p["sign"], p["words"]).alias("units")), _joined))


def _value_of(word: Column) -> Column:
    """A plain decimal without leading and trailing zeros; null where the word is no number."""

    def plain(raw: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(raw, r"^[+-]?([0-9]*)", 1), "^0+(?=[0-9])", "")
        part = F.regexp_replace(F.regexp_extract(raw, r"^[+-]?[0-9]*\.([0-9]*)$", 1), "0+$", "")
        number = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
        return F.when(raw.rlike(r"^[+-]?(?=\.?[0-9])[0-9]*\.?[0-9]*$"), F.when(raw.startswith("-") & (number != "0"), F.concat(F.lit("-"), number)).otherwise(number))

    return let(F.replace(word, F.lit(","), F.lit("")), plain)


def _units_of(sign: Column, words: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in UNIT_WORDS.items() for x in pair])
    codes = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    said = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.coalesce(F.element_at(named, w), w))
    return F.array_distinct(F.concat(said, F.when(sign != "", F.array(F.coalesce(F.element_at(codes, sign), sign))).otherwise(F.array().cast("array<string>"))))


def _joined(p: Column) -> Column:
    value, units = p["value"], p["units"]
    scale, code = F.get(F.filter(units, lambda u: u.isin(*SCALES)), F.lit(0)), F.get(F.filter(units, lambda u: u.isin(*CODES)), F.lit(0))
    powers = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, float(10**v))])

    def scientific(x: Column) -> Column:
        digits = F.regexp_replace(F.format_string("%e", x), r"\.?0*e", "e")
        return F.when(x == 0, F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(digits, r"e\+0*(?=[0-9])", "e"), "e-0*(?=[0-9])", "e-"))

    one = F.concat(value, F.lit("|"), F.coalesce(F.get(units, F.lit(0)), F.lit("")))
    two = F.when(scale.isNotNull() & code.isNotNull(), F.concat(let(value.cast("double") * F.element_at(powers, scale), scientific), F.lit("|"), code)).otherwise(F.lit(""))
    return F.when(value.isNull() | (F.size(units) > 2) | F.exists(units, lambda u: ~u.isin(*UNITS)), F.lit("")).when(F.size(units) < 2, one).otherwise(two)


#: Modal phrases, in the order in which one place is tried, and what they make a clause.
MODALS = (
    ("does not apply", "exclusion"), ("do not apply", "exclusion"), ("not apply", "exclusion"), ("does not affect", "exclusion"), ("except that", "exclusion"), ("must not", "prohibition"), ("shall not", "prohibition"), ("may not", "prohibition"),
    ("must", "obligation"), ("shall", "obligation"), ("required", "obligation"), ("is required to", "obligation"), ("is to", "obligation"), ("may", "permission"),
)
#: Words that can't begin an actor, and those that alone are none.
ACTOR_PREFIXES = ("and", "article", "by", "clause", "for", "from", "in", "of", "on", "or", "page", "pages", "paragraph", "paragraphs", "part", "parts", "section", "sections", "subsection", "subsections", "that", "this", "to", "within")
ACTOR_NOISE = (*ACTOR_PREFIXES, "is", "it", "may", "must", "not", "shall", "with", "without", "according", "amending", "amended", "apply", "applies", "as", "pursuant", "unless", "a", "an", "the")
OBJECT_ENDS = ("on", "in", "within", "during", "while", "until", "upon", "when")


def clauses(text: Column) -> Column:
    """Arrays of a text's words between white space, each up to a word that ends in a full stop or semicolon."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.;])(?=\s|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")), lambda w: F.size(w) > 0)


def plain_word(word: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(word), "[.,;:]+$", ""))


def modal_of(words: Column) -> Column:
    """kind, surface, at, n of the first modal phrase among plain words (the earliest place, then the table's order); null without one."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def found(order: int, phrase: str, kind: str) -> Column:
        before = F.substring_index(joined, f" {phrase} ", 1)
        place = F.when(F.contains(joined, F.lit(f" {phrase} ")), F.size(F.split(before, " ")) - 1)
        return F.when(place.isNotNull(), F.struct(place.alias("at"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.lit(phrase).alias("surface"), F.lit(len(phrase.split())).alias("n")))

    return F.array_min(F.array_compact(F.array(*[found(i, p, k) for i, (p, k) in enumerate(MODALS)])))


def modality(clause: Column) -> Column:
    """exclusion, prohibition, obligation or permission by the first modal phrase of a clause; null without any."""
    return modal_of(F.transform(F.filter(F.split(clause, r"\s+"), lambda w: w != ""), plain_word))["kind"]
