"""Text and links of HTML pages, in expressions only."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Elements whose content isn't shown; the last may hold others of its kind.
HIDDEN = ("script", "style", "template")
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav")
#: How deep templates in templates are followed.
DEPTH = 4


def _without_hidden(html: Column) -> Column:
    """A page without comments and hidden elements; templates go from the inside out."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN[:2]:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    for _ in range(DEPTH):
        out = F.regexp_replace(out, r"(?is)<template\b[^>]*>[^<]*+(?:<(?!/?template\b)[^<]*+)*+</template\s*>", "")
    return out


def _lines(html: Column) -> Column:
    """Block tags as line ends, other tags gone."""
    return F.regexp_replace(F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n"), r"<[^>]*>", "")


def stripped(html: Column) -> Column:
    """Text of a page with the five commonest entities read; lines trimmed, empty ones dropped."""
    out = _lines(_without_hidden(html))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def unescaped(text: Column) -> Column:
    """A text with all named entities that end in a semicolon, and all numbered ones, read once from left to right."""
    names = F.create_map(*[F.lit(x) for name, char in sorted(html5.items()) if name.endswith(";") and len(name) < 9 for x in (name, char)])

    def read(part: Column) -> Column:
        # What follows an ampersand, up to the next one.
        name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,6};|#[0-9]{1,7};|[A-Za-z][A-Za-z0-9]{1,7};)", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.regexp_replace(name, "[#xX;]", ""), 16, 10)).otherwise(F.regexp_replace(name, "[#;]", "")).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")).when(name != "", F.element_at(names, name))
        return F.coalesce(F.concat(char, F.substring(part, F.length(name) + 1, F.length(part))), F.concat(F.lit("&"), part))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), lambda x: F.concat(F.get(x, F.lit(0)), F.array_join(F.transform(F.slice(x, 2, F.size(x)), read), "")))).otherwise(text)


def visible(html: Column) -> Column:
    """Text of a page, all entities read, runs of white space as one space, lines trimmed, empty ones dropped; null stays null."""
    lines = F.split(unescaped(_lines(_without_hidden(html))), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\s\xa0]+", " "))), lambda x: x != ""), "\n")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, text of pages(page_id, html)."""
    return pages.select("page_id", visible(F.col("html")).alias("text"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, target (absolute), same_host of every link of a page, each target once."""
    found = pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    absolute = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(origin, F.col("href"))).otherwise(F.concat(origin, F.lit("/"), F.col("href")))
    rows = found.filter("href <> '' and not startswith(href, '#')").select("page_id", origin.alias("origin"), F.regexp_replace(absolute, "#.*$", "").alias("target"))
    return rows.select("page_id", "target", (F.regexp_extract("target", r"^([a-z]+://[^/?#]+)", 1) == F.col("origin")).alias("same_host")).distinct()
