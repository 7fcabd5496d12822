"""Prose of pasted threads and of web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions.text import sub, trim_all

# Lines of a pasted thread that belong to the page and not to a comment.
CHROME = (
    "upvote", "downvote", "reply", "award", "share", "repost", "vote", "upvotevote", "join", "learn more", "shop now", "order now", "ad",
    "go to comments", "sort by:", "best", "search comments", "expand comment search", "comments section", "join the conversation",
    "collapse video player", "view more comments", "community info section", "cake icon", "public", "wiki", "secret", "full rules", "reddiquette",
    "related subreddits", "moderators", "message mods", "view all moderators", "installed apps", "reddit rules", "privacy policy", "user agreement",
    "your privacy choices", "accessibility", "collapse navigation", "community guide", "community bookmarks", "resources", "comment mop", "edited",
    "deleted", "[deleted]", "ask reddit...",
)
# What makes a line part of the page, on the line and on its lower-cased form.
LINE = r"(?i)^[\d.,]+[km]?$|^\d+[hdmy]o?\s*ago$|^edited\s|^â¢$|^•$|^\d+\s+more repl(y|ies)$|^\d+\s+more$|^rule \d+ -"
LOWERED = r"^https?://|\.com$|\.org$|\.tech$|\.io$|^clickable image|^thumbnail image|^created jan|^r/|^0:00|avatar"
USER = r"^u/[\w-]+|^[\w-]{3,20}$"
# What pasting leaves of typographic marks (UTF-8 read byte by byte), and what stands for them; the longer ones first.
MOJIBAKE = (
    ("\u00e2\u0080\u0099", "'"), ("\u00e2\u0080\u0098", "'"), ("\u00e2\u0080\u009c", '"'), ("\u00e2\u0080\u009d", '"'), ("\u00e2\u0080\u00a6", "..."), ("\u00e2\u0080\u0093", "-"),
    ("\u00e2\u0080\u0094", "-"), ("\u00e2\u0080\u00a2", ""), ("\u00e2\u00a6", "..."), ("\u00e2\u00a2", ""), ("\u00e2", "'"),
)
# Elements whose text is not prose, and elements that end a block of text.
SKIPPED = "script style noscript code pre kbd samp var textarea select button svg math title head iframe object canvas a".split()
BLOCKS = "p|li|td|tr|ul|ol|table|blockquote|article|section|div|body|html|h[1-6]|br|nav|header|footer|main"


def repair(c: Column) -> Column:
    """A pasted text with its damaged marks mended, trimmed."""
    for damaged, mark in MOJIBAKE:
        c = F.replace(c, F.lit(damaged), F.lit(mark))
    return trim_all(c)


def comments(c: Column, chrome: tuple[str, ...] = CHROME) -> Column:
    """Comment bodies of a pasted thread: runs of lines between page lines and user names, each joined by spaces; of two words at least."""
    low = lambda x: F.lower(x)
    page = lambda x: (x == "") | low(x).isin(*chrome) | x.rlike(LINE) | low(x).rlike(LOWERED) | (x.rlike(USER) & ~x.contains(" ") & (F.length(x) < 21))
    lines = F.transform(F.transform(F.split(c, r"\r\n|\n|\r"), trim_all), lambda x: F.struct(x.alias("x"), page(x).alias("page")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    close = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    grow = lambda acc, x: F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
    runs = F.aggregate(lines, start, lambda acc, l: F.when(l["page"], F.struct(close(acc).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), grow(acc, l["x"]).alias("open"))), close)
    runs = F.transform(runs, repair)
    return F.filter(runs, lambda r: F.regexp_count(r, F.lit(r"\S+")) >= 2)


def blocks(html: Column, least: int = 20) -> Column:
    """Blocks of running text of a page, over ``least`` characters long, in order."""
    for tag in SKIPPED:
        html = sub(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    html = sub(sub(html, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\u0001"), r"<[^>]+>", "")
    pieces = F.transform(F.split(html, "\u0001"), lambda x: trim_all(sub(x, r"\s+", " ")))
    return F.filter(pieces, lambda x: F.length(x) > least)
