"""Feeds as rows: counted repairs, the kind of feed, its items and their fields.

All built-in expressions: a feed is one string, an item one match of its element.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUNK, CONTROL, BARE = r"^[^<]+", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"&(?![A-Za-z][A-Za-z0-9]{0,31};|#[0-9]{1,7};|#x[0-9A-Fa-f]{1,6};)"
REPAIRS = ("leading_junk", "control_chars", "html_entity", "bare_ampersand")
#: Names that markup knows and XML does not.
NAMED = {n: chr(c) for n, c in name2codepoint.items() if n not in ("lt", "gt", "amp", "quot", "apos")}
#: Where defects do not count: a parser takes these as they are.
VERBATIM = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"


def repaired(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Feeds with their text repaired and a count of each kind of repair.

    A feed that a strict parser takes stays as it is, whatever its CDATA sections hold.
    In others, junk before the first element and control characters go, named characters
    of HTML become the characters, and bare ampersands are escaped.
    """
    chars = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    name = lambda piece: F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    known = lambda piece: chars[name(piece)].isNotNull()
    strict = F.regexp_replace(F.col(body), VERBATIM, "")
    flawed = strict.rlike(JUNK) | strict.rlike(CONTROL) | strict.rlike(BARE) | F.exists(F.slice(F.split(strict, "&"), 2, 1_000_000_000), known)
    count = lambda pattern: F.when(F.col("flawed_"), F.regexp_count(F.col(body), F.lit(pattern))).otherwise(0).cast("long")
    change = lambda out, to: out.withColumn(body, F.when(F.col("flawed_"), to).otherwise(F.col(body)))
    out = feeds.withColumn("flawed_", flawed)
    out = change(out.withColumn("leading_junk", count(JUNK)), F.regexp_replace(body, JUNK, ""))
    out = change(out.withColumn("control_chars", count(CONTROL)), F.regexp_replace(body, CONTROL, ""))
    out = out.withColumn("pieces_", F.split(body, "&"))
    later = F.slice("pieces_", 2, 1_000_000_000)
    out = out.withColumn("html_entity", F.when(F.col("flawed_"), F.size(F.filter(later, known))).otherwise(0).cast("long"))
    text = F.concat(F.col("pieces_")[0], F.array_join(F.transform(later, lambda p: F.when(known(p), F.concat(chars[name(p)], F.substring(p, F.length(name(p)) + 2, F.length(p)))).otherwise(F.concat(F.lit("&"), p))), ""))
    out = change(out, text)
    return change(out.withColumn("bare_ampersand", count(BARE)), F.regexp_replace(body, BARE, "&amp;")).drop("flawed_", "pieces_")


def kind(body: Column) -> Column:
    """By the root element."""
    root = F.lower(F.regexp_extract(body, r"<(?![?!])\s*([A-Za-z:]+)", 1))
    return F.when(root == "rss", "rss").when(root == "feed", "atom").when(root == "rdf:rdf", "rdf")


def field(item: Column, *names: str) -> Column:
    """The first of these elements that has content, CDATA unwrapped."""
    found = [F.regexp_extract(item, rf"(?s)<{n}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>", 1) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def atom_link(item: Column) -> Column:
    """The alternate link, else the first link, else the id."""
    links = F.regexp_extract_all(item, F.lit(r"(<link\s[^>]*>)"))
    href = lambda x: F.regexp_extract(x, r'href="([^"]*)"', 1)
    other = F.filter(links, lambda x: x.contains('rel="alternate"') | ~x.contains("rel="))
    return F.coalesce(F.when(F.size(other) > 0, href(F.get(other, F.lit(0)))), F.when(F.size(links) > 0, href(F.get(links, F.lit(0)))), field(item, "id"))


def items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row an item: feed columns, position, title, link, published, dek."""
    rows = feeds.withColumn("kind", kind(F.col(body)))
    tag = F.when(F.col("kind") == "atom", r"(?s)(<entry[\s>].*?</entry>)").otherwise(r"(?s)(<item[\s>].*?</item>)")
    rows = rows.select("*", F.posexplode(F.regexp_extract_all(F.col(body), tag)).alias("position", "item")).drop(body)
    link = F.when(F.col("kind") == "atom", atom_link(F.col("item"))).otherwise(field(F.col("item"), "link", "guid"))
    return rows.select("*", field(F.col("item"), "title").alias("title"), link.alias("link"), field(F.col("item"), "pubDate", "updated", "published", "dc:date").alias("published"), field(F.col("item"), "description", "summary", "content").alias("dek")).drop("item")
