"""Plain Python versions of the corpus operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(text, rules):
    spans = []
    for n, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.at_least:
                spans.append((m.start(), n, m.end()))
    return sorted(spans)


def redacted(text, rules, placeholder):
    merged = []
    for start, _, end in secrets(text, rules):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = "", 0
    for start, end in merged:
        out, at = out + text[at:start] + placeholder, end
    return out + text[at:] if merged else text


def simhash(text, width=4):
    import xxhash

    words = SPACE.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(prints, distance=4):
    """Index of the first row of each row's class."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(prints))]


def contamination(docs, items, window=13):
    """(n_words, n_hit, item ids as strings in order, contaminated) of each text."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known, lengths = defaultdict(set), set()
    for item, text in items:
        w = word.findall((text or "").translate(LOW))
        if w and item is not None:
            n = min(window, len(w))
            lengths.add(n)
            for i in range(len(w) - n + 1):
                known[tuple(w[i : i + n])].add(item)
    out = []
    for text in docs:
        w = word.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def features(text):
    text = text or ""
    n, chars, symbols, dup, repeat = statistics(text)
    lines = len([x for x in text.split("\n") if SPACE.search(x)])
    share = lambda a, b: a / b if b else 0.0
    upper = sum(1 for c in text if c.isupper())
    return {
        "words": float(n), "word_length": share(chars, n), "symbols": share(symbols, n), "dup_lines": share(dup, lines), "repeat_words": share(repeat, n),
        "distinct": share(len(set(SPACE.findall(text))), n), "upper": share(upper, chars), "stops": share(sum(c in ".,;:!?" for c in text), n),
        "digits": share(sum(c in "0123456789" for c in text), chars), "line_words": share(n, lines),
    }


def _luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _permuted(value, a, b, key, kind):
    left, right = divmod(value, b)
    for n in range(8):
        f = int(sha(f"{key}|{kind}|{n}|{left if n % 2 else right}")[:13], 16)
        if n % 2:
            right = (right + f % b) % b
        else:
            left = (left + f % a) % a
    return left * b + right


def _filled(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if "0" <= c <= "9" else c for c in shape)


def _pseudonym(kind, old, key):
    """The text that takes old's place; None where it fails validation."""
    import datetime as dt

    digits = "".join(c for c in old if c in "0123456789")
    if kind == "email":
        return f"user-{sha(f'{key}|email|{old.lower()}')[:16]}@mail.invalid"
    if kind == "date":
        order = (0, 1, 2) if old[4] == "-" else (2, 1, 0)
        parts = re.split("[-/.]", old)
        try:
            day = dt.date(*(int(parts[i]) for i in order))
        except ValueError:
            return None
        since = (day - dt.date(1800, 1, 1)).days
        if not 0 <= since < 189 * 773:
            return None
        new = dt.date(1800, 1, 1) + dt.timedelta(_permuted(since, 189, 773, key, kind))
        return new.strftime({"-": "%Y-%m-%d"}.get(old[4]) or f"%d{old[2]}%m{old[2]}%Y")
    if kind == "ssn":
        area, group, serial = (int(x) for x in old.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        v = _permuted((area - (2 if area > 666 else 1)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, kind)
        area, rest = divmod(v, 99 * 9999)
        return f"{area + 1 + (area + 1 >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "phone":
        code = 0 if old[0] != "+" else 2 if old[1:].isdigit() else len(re.match(r"\+([0-9]+)", old)[1])
        body = digits[code:]
        if len(body) > 18:
            return None
        half = len(body) // 2
        v = _permuted(int(body), 10**half, 10 ** (len(body) - half), key, kind)
        return _filled(old, digits[:code] + str(v).rjust(len(body), "0"))
    if kind == "ip":
        parts = [int(p) for p in old.split(".")]
        if max(parts) > 255:
            return None
        v = _permuted(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, key, kind)
        return ".".join(map(str, v.to_bytes(4, "big")))
    if not _luhn_ok(digits):
        return None
    n = len(digits) - 1
    body = str(_permuted(int(digits[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), key, kind)).rjust(n, "0")
    return _filled(old, body + next(c for c in "0123456789" if _luhn_ok(body + c)))


def pii(text, key):
    """The masked text and its spans (kind, start, end): matches by a backtracking engine, cards by trying all groups."""
    import regex

    from docloom.llm import pii_mask

    ascii_digits = {k: p.replace(r"\d", "[0-9]") for k, p in pii_mask.PATTERNS.items()}
    layouts = [tuple(map(int, x.split())) for x in pii_mask.LAYOUTS]
    out, spans, at = [], [], 0

    def put(kind, start, old):
        new = _pseudonym(kind, old, key)
        out.append(old if new is None else new)
        if new is not None:
            spans.append((kind, start, start + len(old)))

    for m in regex.finditer("|".join(ascii_digits.values()), text or ""):
        out.append(text[at : m.start()])
        at = m.end()
        kind = next((k for k, p in ascii_digits.items() if regex.fullmatch(p, m[0])), None)
        if kind is None:  # fewer than 13 digits before another kind
            out.append(m[0])
            continue
        if kind != "card":
            put(kind, m.start(), m[0])
            continue
        groups = list(re.finditer("[0-9]+", m[0]))
        i = 0
        while i < len(groups):
            fits = []
            for k in range(1, min(19, len(groups) - i) + 1):
                own = [g[0] for g in groups[i : i + k]]
                if 13 <= len("".join(own)) <= 19 and _luhn_ok("".join(own)):
                    fits.append((tuple(map(len, own)) in layouts, k))
            k = max(fits)[1] if fits else 1
            begin, end = groups[i].start(), groups[i + k - 1].end()
            out.append(m[0][groups[i - 1].end() if i else 0 : begin])
            if fits:
                put("card", m.start() + begin, m[0][begin:end])
            else:
                out.append(m[0][begin:end])
            i += k
    return (None if text is None else "".join(out) + text[at:]), spans
