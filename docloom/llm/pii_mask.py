"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel network, so the
same value gets the same pseudonym in every document, different values get different ones, separators
stay, and a pseudonym passes the same validation. Kinds, in the order in which one place is tried:

* email: local part (the last 64 characters of it at most) and domain (up to 127 labels of 63 before the
  last) become a keyed hash under ``.invalid`` (an address has no fixed format);
* date: ``yyyy-mm-dd`` (also before a time, as in ``yyyy-mm-ddThh:``), ``dd/mm/yyyy`` and
  ``dd.mm.yyyy`` that exist in 1800 to 2199. Those 400 years are 146,097 = 189 * 773 days, the two halves of the network, so no date leaves the range;
* ssn: ``ddd-dd-dddd`` with an area of 001 to 899 but 666, and no zero part, over 898 * (99 * 9999);
* phone: ``+`` and a country code with groups of digits after it, ``+`` with 8 to 15 digits at once, ``(ddd)
  ddd-dddd``, ``ddd-ddd-dddd`` and ``ddd.ddd.dddd``: the n digits after the country code (after the first
  two, where no mark ends it) over 10^(n // 2) * 10^(n - n // 2), n being 18 at most;
* ip: four numbers to 255 over 65,536 * 65,536;
* card: 13 to 19 digits, alone or with single spaces or hyphens, that pass the Luhn check: all but the
  check digit are permuted, and the check digit is computed anew. A run of groups of digits ends before
  any other kind and is searched from each group on for whole groups that pass: common layouts first,
  then the longest. Of cards that overlap the first in the text is taken.

Numbers and dates that fail validation are left as they are. Each half changes by the other's keyed
SHA-256, added modulo its size, in eight rounds; unmask=True runs them backwards (not for emails).

Every repetition in the patterns is of single characters, possessive or of at most 127 rounds, so a
text of any length and content needs a bounded stack and steps in proportion to it.

Defined results: a null text stays null, an empty one empty; texts without a match are returned as
they are; repeated rows come out once each, masked alike; an empty table gives none; columns other
than text aren't touched, whatever their names. A text's matches are replaced in one pass, so a
pseudonym is never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, placed

ROUNDS = 8
KINDS = ("email", "date", "ssn", "phone", "ip", "card")
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,127}[A-Za-z]{2,24}" + _END,
    "date": _EDGE + r"(?:\d{4}-\d{2}-\d{2}(?:(?=T\d{2}:)|" + _END + r")|(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _END + ")",
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}|\+(?!1[ .(-])\d{1,3}(?: ?\(\d{1,4}\)|[ .-]\d{1,4})(?:[ .-](?!\d{1,3}(?:\.\d{1,3}){3}|\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-\d{4}|\d{4}[ -]\d{4}[ -]\d{4})\d{2,4}){1,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4})" + _END,
    "ip": r"(?<![\p{L}\p{N}_.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}_]|\.\d)",
}
# Groups of digits up to where another kind begins; possessive, so that long runs need no stack.
_STOP = "|".join([r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)", *[PATTERNS[k] for k in ("ssn", "phone", "ip")], r"\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}" + _END, r"[\p{L}\p{N}._%+-]{1,64}@"])
PATTERNS["card"] = _EDGE + r"(?=(?:\d[ -]?){12}\d)\d++" + _END + r"(?:[ -](?!" + _STOP + r")\d++" + _END + ")*+"
#: Numbers of digits in the groups of common cards.
LAYOUTS = ("4 4 4 4", "4 6 5", "4 6 4", "4 4 4 4 3", *map(str, range(13, 20)))
ANY = "|".join(PATTERNS[k] for k in KINDS)
_DAYS, _FIRST_DAY = (189, 773), "1800-01-01"


def _keyed(key: str, tweak: Column, n: Column, half: Column) -> Column:
    """A number below 2^52 from the key, the kind, the round and a half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, n.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A permutation of 0 .. a * b - 1. Even rounds change the left half (modulo a), odd ones the right (modulo b)."""
    sign = -1 if back else 1
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        f = _keyed(key, tweak, n, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, F.pmod(s["l"] + sign * (f % a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * (f % b), b)).alias("r"),
        )

    first = F.struct(F.floor(_div(value, b)).alias("l"), (value % b).alias("r"))
    return F.aggregate(order, first, step, lambda s: s["l"] * b + s["r"])


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return F.call_function("div", a, b)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _pour(digits: Column, shape: Column) -> Column:
    """Digits in the places of shape's digits."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum of 13 to 19 digits with the last one counted once, by arithmetic on the last nine and on those before."""
    halves = F.struct(F.substring(digits, F.length(digits) - 8, F.lit(9)).cast("long").alias("low"), F.substring(digits, F.lit(1), F.length(digits) - 9).cast("long").alias("high"))

    def total(h: Column) -> Column:
        out = None
        for i in range(19):
            d = _div(h["low" if i < 9 else "high"], _long(10 ** (i % 9 if i < 18 else 9))) % 10
            one = d * 2 - _div(d, _long(5)) * 9 if i % 2 else d
            out = one if out is None else out + one
        return out

    return F.get(F.transform(F.array(halves), total), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


# Of each kind: the value behind a match (null where validation fails), the sizes of its halves, and the text of a value.


def _card_value(x: Column) -> tuple[Column, Column, Column]:
    digits = _digits(x)
    n = F.length(digits) - 1
    powers = F.array(*[_long(10**i) for i in range(11)])
    return F.when(_luhn(digits) % 10 == 0, F.substring(digits, F.lit(1), n).cast("long")), F.get(powers, F.floor(n / 2).cast("int")), F.get(powers, (n - F.floor(n / 2)).cast("int"))


def _card_text(v: Column, x: Column) -> Column:
    body = F.lpad(v.cast("string"), F.length(_digits(x)) - 1, F.lit("0"))
    check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return _pour(F.concat(body, check.cast("string")), x)


def _date_value(x: Column) -> tuple[Column, Column, Column]:
    iso = F.when(F.substring(x, 5, 1) == "-", x).otherwise(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)))
    since = F.datediff(F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd")), F.lit(_FIRST_DAY).cast("date")).cast("long")
    return F.when(since.between(0, _DAYS[0] * _DAYS[1] - 1), since), _long(_DAYS[0]), _long(_DAYS[1])


def _date_text(v: Column, x: Column) -> Column:
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), v.cast("int"))
    return F.when(F.substring(x, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).when(F.substring(x, 3, 1) == "/", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))


def _ssn_value(x: Column) -> tuple[Column, Column, Column]:
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    b = _long(99 * 9999)
    return F.when(valid, (area - F.when(area > 666, 2).otherwise(1)) * b + (group - 1) * 9999 + serial - 1), _long(898), b


def _ssn_text(v: Column, x: Column) -> Column:
    b = _long(99 * 9999)
    low, rest = _div(v, b) + 1, v % b
    parts = low + F.when(low >= 666, 1).otherwise(0), _div(rest, _long(9999)) + 1, rest % 9999 + 1
    return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)])


def _code(x: Column) -> Column:
    """How many digits the country code has."""
    return F.when(~F.startswith(x, F.lit("+")), 0).when(F.rlike(x, F.lit("^.[0-9]+$")), 2).otherwise(F.length(F.regexp_extract(x, "^.([0-9]+)", 1)))


def _phone_value(x: Column) -> tuple[Column, Column, Column]:
    body = F.substring(_digits(x), _code(x) + 1, F.lit(32))
    half = F.floor(F.length(body) / 2).cast("int")
    powers = F.array(*[_long(10**i) for i in range(10)])
    return F.when(F.length(body) <= 18, body).cast("long"), F.get(powers, half), F.get(powers, F.length(body) - half)


def _phone_text(v: Column, x: Column) -> Column:
    digits = _digits(x)
    return _pour(F.concat(F.substring(digits, F.lit(1), _code(x)), F.lpad(v.cast("string"), F.length(digits) - _code(x), F.lit("0"))), x)


def _ip_value(x: Column) -> tuple[Column, Column, Column]:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    return F.when(F.forall(parts, lambda p: p < 256), F.aggregate(parts, _long(0), lambda a, p: a * 256 + p)), _long(1 << 16), _long(1 << 16)


def _ip_text(v: Column, x: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])


_VALUES = {"date": _date_value, "ssn": _ssn_value, "phone": _phone_value, "ip": _ip_value, "card": _card_value}
_TEXTS = {"date": _date_text, "ssn": _ssn_text, "phone": _phone_text, "ip": _ip_text, "card": _card_text}


def _by_kind(kind: Column, makers: dict) -> Column:
    out = None
    for k, made in makers.items():
        out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
    return out


def _kind_of(x: Column) -> Column:
    out = None
    for k in KINDS:
        test = F.rlike(x, F.lit(f"^(?:{PATTERNS[k]})$"))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


_CUT = "array<struct<old: string, kind: string>>"
#: A letter before a group says how many groups from it on are a card: A none, B one, up to T for 19.
_LETTERS = "ABCDEFGHIJKLMNOPQRST"
_SEGMENT = "A[^A-T]*+|" + "|".join(f"{c}[^A-T]*+" + (f"(?:[A-T][^A-T]*+){{{n - 1}}}" if n > 1 else "") for n, c in enumerate(_LETTERS) if n)


def _card_groups(groups: Column) -> Column:
    """How many of up to 19 groups of digits, from the first on, are a card; 0 if none."""
    spans = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.struct(F.array_join(F.slice(groups, 1, k), "").alias("digits"), k.alias("k")))
    fit = F.filter(F.filter(spans, lambda x: F.length(x["digits"]).between(13, 19)), lambda x: _luhn(x["digits"]) % 10 == 0)

    def rank(x: Column) -> Column:
        return F.struct(F.array_join(F.transform(F.slice(groups, 1, x["k"]), lambda g: F.length(g).cast("string")), " ").isin(*LAYOUTS).alias("known"), x["k"].alias("k"))

    return F.coalesce(F.array_max(F.transform(fit, rank))["k"], F.lit(0))


def _cards(run: Column) -> Column:
    """A run of groups of digits as an array of old and kind: its cards, and what is between them (no kind).

    Each group gets a letter for the card that begins there; one more pattern then reads the letters from
    left to right and takes as many groups as they say, so the steps grow with the run's length alone."""
    windows = F.regexp_extract_all(run, F.lit(r"(?=(\d{1,20}(?:[ -]\d{1,20}){0,18}))\d++"), F.lit(1))
    units = F.regexp_extract_all(run, F.lit(r"[ -]?\d++"), F.lit(0))
    letters = F.transform(F.transform(windows, lambda w: F.split(w, "[ -]")), lambda g: F.substring(F.lit(_LETTERS), _card_groups(g) + 1, F.lit(1)))
    segments = F.regexp_extract_all(F.array_join(F.zip_with(letters, units, lambda a, b: F.concat(a, b)), ""), F.lit(_SEGMENT), F.lit(0))

    def named(segment: Column) -> Column:
        own = F.regexp_replace(segment, "[A-T]", "")
        card = F.array(F.struct(F.regexp_extract(own, "^[ -]?", 0).alias("old"), F.lit(None).cast("string").alias("kind")), F.struct(F.regexp_replace(own, "^[ -]", "").alias("old"), F.lit("card").alias("kind")))
        return F.when(F.startswith(segment, F.lit("A")), F.array(F.struct(own.alias("old"), F.lit(None).cast("string").alias("kind"))).cast(_CUT)).otherwise(card.cast(_CUT))

    return F.flatten(F.transform(segments, named))


def pieces(between: Column, found: Column) -> list:
    """Steps from the texts between matches and the matches to an array of old and kind (null: not personal) that makes up the text."""

    def named(b: Column, x: Column) -> Column:
        return F.struct(b.alias("between"), x.alias("old"), F.when(x.isNotNull(), _kind_of(x)).alias("kind"))

    def cut(x: Column) -> Column:
        own = F.struct(x["old"].alias("old"), x["kind"].alias("kind"))
        return F.concat(F.array(F.struct(x["between"].alias("old"), F.lit(None).cast("string").alias("kind"))), F.when(x["kind"] == "card", _cards(x["old"])).otherwise(F.array(own)))

    return [F.zip_with(between, found, named), lambda c: F.flatten(F.transform(c, cut))]


def pseudonyms(key: str, unmask: bool) -> list:
    """Functions from an array of old and kind, one step at a time, to an array of old, kind and new (null: left as it is)."""

    def valued(x: Column) -> Column:
        found = {k: _VALUES[k](x["old"]) for k in _VALUES}
        fields = [_by_kind(x["kind"], {k: v[i] for k, v in found.items()}).alias(name) for i, name in enumerate(("value", "a", "b"))]
        return F.struct(x["old"].alias("old"), x["kind"].alias("kind"), *fields)

    def permuted(x: Column) -> Column:
        return F.struct(x["old"].alias("old"), x["kind"].alias("kind"), F.when(x["value"].isNotNull(), feistel(x["value"], x["a"], x["b"], key, x["kind"], unmask)).alias("value"))

    def written(x: Column) -> Column:
        mail = F.lit(None).cast("string") if unmask else F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(x["old"])).cast("binary"), 256), 1, 16), F.lit("@mail.invalid"))
        new = F.when(x["kind"] == "email", mail).when(x["value"].isNotNull(), _by_kind(x["kind"], {k: f(x["value"], x["old"]) for k, f in _TEXTS.items()}))
        return F.struct(x["old"].alias("old"), x["kind"].alias("kind"), new.alias("new"))

    return [valued, permuted, written]


def mask(docs: DataFrame, key: str, unmask: bool = False) -> DataFrame:
    """docs with text masked, and a last column (array of kind, start, end in the old text, code points): pii, or pii_2 and so on where docs has that name."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    rows = rows.withColumn("_found", F.when(F.rlike("_text", F.lit(ANY)), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))))

    rows = rows.withColumn("_between", F.when(F.col("_found").isNotNull(), F.split("_text", ANY, -1)))
    paired, cut = pieces(F.col("_between"), F.col("_found"))
    rows = rows.withColumn("_new", paired)
    rows = rows.withColumn("_new", cut(F.col("_new")))
    for step in pseudonyms(key, unmask):
        rows = rows.withColumn("_new", F.transform("_new", step))
    text = F.when(F.col("_found").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_new", lambda n: F.coalesce(n["new"], n["old"], F.lit(""))), ""))
    spans = "array<struct<kind: string, start: int, end: int>>"

    def length(x: Column) -> Column:
        return F.coalesce(F.length(x["old"]), F.lit(0))

    def place(at: Column, x: Column) -> Column:
        own = F.array(F.struct(x["kind"].alias("kind"), at.alias("start"), (at + length(x)).alias("end")))
        return F.when(x["new"].isNotNull(), own.cast(spans)).otherwise(F.array().cast(spans))

    found = F.when(F.col("_new").isNotNull(), placed(F.col("_new"), length, place, spans)).otherwise(F.array().cast(spans))
    done = rows.select("_row", text.alias("_text"), found.alias("_pii"))
    kept = [F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*kept, F.col("_pii").alias(free_name(docs.columns, "pii")))


def digests(masked: DataFrame) -> DataFrame:
    """doc_id, text (masked), n_pii, one count for each kind, and spans as kind:start:end joined by commas."""

    pii = masked.columns[-1]

    def count(kind: str) -> Column:
        return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    spans = F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return masked.select("doc_id", "text", F.size(pii).cast("long").alias("n_pii"), *counts, spans.alias("spans"))
