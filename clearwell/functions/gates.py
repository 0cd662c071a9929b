"""Cheap native tests that say whether a heavier layer can find anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: shapes of markup ---
HTML_TAG = r"<[a-zA-Z/!?][^<>]*>"
MARKDOWN_LINK = r"(?m)\]\(|!\[|^[ \t]*\[[^\[\]\n]+\]:\s"
URL = r"(?i)https?://"

def has_tag(c: Column) -> Column:
    return c.rlike(HTML_TAG)


def has_link(c: Column) -> Column:
    return c.rlike(MARKDOWN_LINK)


def needs_markup(c: Column) -> Column:
    return has_tag(c) | has_link(c)


def has_url(c: Column) -> Column:
    return c.rlike(URL)


def needs_url_scan(c: Column) -> Column:
    return has_url(c) | needs_markup(c)


def non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def is_untrusted_tool(tool: Column) -> Column:
    """Tools whose output comes from outside: web fetches and searches, and connected servers."""
    return tool.isin("WebFetch", "WebSearch") | tool.startswith("mcp__")


def path_is_inside(root: Column, child: Column) -> Column:
    return (child == root) | child.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
