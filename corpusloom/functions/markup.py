"""Extractors of wiki markup: Column (text) -> Column (array), without UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import CJK, INLINE_MARKERS, count_of, strip

# Patterns (fixed values).
TAG = r"(?U)\[\[\s*/?\s*([A-Za-z_][A-Za-z0-9_:.\-]*)"
URL = r"""(?U)https?://[^\s\x1c-\x1f\]|<>"']+"""
PARAM = r"(?U)\|?\s*([A-Za-z_][A-Za-z0-9_\-]*)\s*="
CONSTRUCT = r"(?s)\[\[.*?\]\]"
CODE = r"(?s)\{\{\{.*?\}\}\}"
HEADING = r"(?mdU)^\s*(\+{1,6})\s"
INCLUDE = r"(?iU)\[\[\s*include\s+([^\]|]+)"
MODULE = r"(?iU)\[\[\s*module\s+([^\]|]+)"
TAG_WORD = r"(?U)\[\[\s*(/?)\s*([A-Za-z_][\w:-]*)"
CLOSE = r"(?U)\[\[\s*/\s*([A-Za-z_][\w:-]*)\s*\]\]"
PARAM_NAME = r"(?U)([^\s|\]=]+)\s*="
CODE_TAGGED = r"(?sU)\[\[\s*code[^\]]*\]\](.*?)\[\[\s*/\s*code\s*\]\]"
CODE_BRACES = r"(?s)\{\{\{(.*?)\}\}\}"
#: Tags that need a closing form (fixed values).
PAIRED_TAGS = tuple(
    "align bibcite bold cell center code collapsible color div footnote hidden html iframe italic li math module641 ol "
    "quote raw row size span strikethrough sub sup tab table tabview toc ul underline".split()
)


@dataclass(frozen=True)
class Sites:
    """Names that differ between the two language branches of a wiki and count as one.

    ``hosts`` collapse to ``<wiki>`` in addresses; a leading ``namespace`` (with an
    optional branch such as ``-xx``) and a trailing variant fall off include targets.
    """

    hosts: Sequence[str] = ()
    namespace: str = "wiki"
    variants: Sequence[str] = ("standalone", "source", "dev", "base", "cn", "en")


def find(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def constructs_only(c: Column) -> Column:
    """The constructs of a text, end to end, and what follows a last ``[[`` that is never closed.

    ``tag_names``, ``params``, ``includes``, ``modules``, ``protected_tokens``, ``opened`` and ``closed`` find the same
    in it as in the text: every ``[[`` stands in one of these parts, and what they match ends before the next ``]``
    or with the next ``]]``.
    """
    rest = F.substring_index(c, "]]", -1)
    open_ = F.when(F.contains(rest, F.lit("[[")), F.regexp_extract(rest, r"(?s)\[\[.*", 0)).otherwise("")
    return F.concat(F.array_join(find(c, CONSTRUCT, 0), ""), open_)


def tag_names(c: Column) -> Column:
    return F.transform(find(c, TAG), lambda t: F.rtrim(F.lower(t), F.lit("_")))


def canonical_url(url: Column, sites: Sites = Sites()) -> Column:
    if not sites.hosts:
        return url
    hosts = "|".join(h.replace(".", r"\.") for h in sites.hosts)
    whole = rf"(?i)^(?:https?://)?(?:www\.)?(?:{hosts})(/.*)?$"
    return F.when(F.rlike(url, F.lit(whole)), F.concat(F.lit("<wiki>"), F.regexp_extract(url, whole, 1))).otherwise(url)


def urls(c: Column, sites: Sites = Sites()) -> Column:
    return F.transform(find(c, URL, 0), lambda u: canonical_url(F.rtrim(u, F.lit(".,;:)")), sites))


def params(c: Column) -> Column:
    """Lower-cased parameter names inside constructs."""
    return F.transform(F.flatten(F.transform(find(c, CONSTRUCT, 0), lambda x: find(x, PARAM))), F.lower)


def inline_counts(c: Column) -> Column:
    return F.create_map(*(x for m in INLINE_MARKERS for x in (F.lit(m), count_of(c, m))))


def canonical_include(target: Column, sites: Sites = Sites()) -> Column:
    key = F.lower(strip(target))
    key = F.regexp_replace(key, rf"^:?{sites.namespace}(?:-cn)?(?:-[a-z]+)?:", "")
    return F.regexp_replace(key, rf"-(?:{'|'.join(sites.variants)})$", "")


def includes(c: Column, sites: Sites = Sites()) -> Column:
    return F.transform(find(c, INCLUDE), lambda t: canonical_include(t, sites))


def modules(c: Column) -> Column:
    return F.transform(find(c, MODULE), lambda t: F.lower(strip(t)))


def protected_tokens(c: Column) -> Column:
    """array<struct<kind, token>>: tag words, include and module targets, parameter names, in this order."""

    def of(kind: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    names = F.flatten(F.transform(find(c, CONSTRUCT, 0), lambda x: find(x, PARAM_NAME)))
    return F.concat(of("tag", find(c, TAG_WORD, 2)), of("include", F.transform(find(c, INCLUDE), strip)), of("module", F.transform(find(c, MODULE), strip)), of("param", names))


def opened(c: Column) -> Column:
    """Lower-cased words of opening tags."""
    words = F.arrays_zip(find(c, TAG_WORD, 1).alias("slash"), find(c, TAG_WORD, 2).alias("word"))
    return F.transform(F.filter(words, lambda w: w["slash"] != "/"), lambda w: F.lower(w["word"]))


def closed(c: Column) -> Column:
    return F.transform(find(c, CLOSE), F.lower)


def code_bodies(c: Column) -> Column:
    """Bodies of code blocks with collapsed white space; blank ones are left out."""
    bodies = F.concat(find(c, CODE_TAGGED), find(c, CODE_BRACES))
    tidy = F.transform(bodies, lambda b: strip(F.regexp_replace(b, r"(?U)[\s\x1c-\x1f]+", " ")))
    return F.filter(tidy, lambda b: b != "")


def has_cjk(c: Column) -> Column:
    return F.rlike(c, F.lit(CJK))
