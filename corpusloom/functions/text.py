"""Scalar text operators as Column -> Column functions.

Patterns follow the semantics of Unicode-aware regular expressions in which ``^``
follows ``\\n`` only and white space includes U+001C to U+001F; Java needs the
flags ``(?U)`` and ``(?d)`` and an explicit class for that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\x1c-\x1f"
SPACE = f"[{_SPACES}]"
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: What ``SPACE`` matches, one by one.
_ALL_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029" + SPACE_SEPARATORS
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}]"
#: Markers removed from plain text, in this order (fixed values).
INLINE_MARKERS = ("**", "//", "__", "--", "##")
EXTENSIONS = (".txt",)
#: Language suffixes of file names and markers of page variants (fixed values).
ID_SUFFIXES = ("_zh", "-zh", "_cn", "-cn", "_zh-cn", "_chinese", "_中文", ".zh", ".cn", "_translated")
VARIANT_MARKERS = ("-D", "-ARC", "-EX", "-J", "-OLD", "-NEW", "-TEST")


def strip(c: Column) -> Column:
    """Without white space at both ends (all Unicode white space)."""
    return F.btrim(c, F.lit(_ALL_SPACES))


def text(c: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def split_paragraphs(c: Column, min_chars: int = 1) -> Column:
    """Paragraphs between blank lines, stripped, of at least ``min_chars`` characters; null gives an empty array."""
    parts = F.transform(F.split(text(c), r"\n[ \t]*\n[ \t\n]*"), strip)
    return F.filter(parts, lambda p: F.length(p) >= max(min_chars, 0))


def lines(c: Column) -> Column:
    """Lines as they stand, without those of space separators (Unicode category Zs) alone; null gives an empty array."""
    return F.filter(F.split(text(c), "\n"), lambda x: F.btrim(x, F.lit(SPACE_SEPARATORS)) != "")


def normalize_text(c: Column, bom: bool = True, newlines: bool = True, trim: bool = True) -> Column:
    """Drop leading byte-order marks, unify line ends, strip line feeds, blanks and tabs; each step can be turned off."""
    out = text(c)
    if bom:
        out = F.regexp_replace(out, r"\A\x{FEFF}+", "")
    if newlines:
        out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(out, F.lit("\n \t")) if trim else out


def _any_of(values: Sequence[str]) -> str:
    return "|".join(re.escape(v) for v in sorted((v for v in values if v), key=len, reverse=True))


def strip_extension(c: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    """Without the longest matching extension, whatever its case."""
    found = _any_of(extensions)
    return F.regexp_replace(c, f"(?i)({found})$", "") if found else c


def derive_id(c: Column, extensions: Sequence[str] = EXTENSIONS, suffixes: Sequence[str] = ID_SUFFIXES) -> Column:
    """A file name without extension and without any number of language suffixes."""
    found = _any_of(suffixes)
    name = strip_extension(c, extensions)
    return strip(F.regexp_replace(name, f"(?i)({found})+$", "") if found else name)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, by Arrow batches, only where a text is not ASCII."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), run(c)).otherwise(c)


def normalize_id(c: Column, compose: bool = True) -> Column:
    """A key that ignores case, blanks and underscores.  ``compose=False`` skips NFKC for identifiers known to be ASCII."""
    out = nfkc(text(c)) if compose else text(c)
    out = strip(F.translate(out, "－—–：＿　", "---:_ "))
    out = F.regexp_replace(out, rf"(?U)(?:{SPACE}|_)+", "-")
    return F.upper(F.regexp_replace(out, "-{2,}", "-"))


def side_hash(paragraphs: Column) -> Column:
    """Order-sensitive SHA-1 of paragraphs, each followed by a NUL."""
    return F.sha1(F.concat_ws("", F.transform(paragraphs, lambda p: F.concat(p, F.lit("\0")))))


def length_ratio(source: Column, target: Column) -> Column:
    return F.length(target) / F.greatest(F.length(source), F.lit(1))


def group_key(c: Column, markers: Sequence[str] = VARIANT_MARKERS) -> Column:
    """The page a variant belongs to: one trailing marker removed if something remains."""
    key = strip(c)
    found = _any_of(markers)
    if not found:
        return key
    hit = rf"(?is)\A.+(?:{found})\z"
    return F.when(F.rlike(key, F.lit(hit)), F.rtrim(F.regexp_replace(key, rf"(?is)(?<=.)(?:{found})\z", ""), F.lit("-_ "))).otherwise(key)


def document_of(row_id: Column, doc: Column | None = None) -> Column:
    """The document of a sample: ``doc`` if given, else the id up to the first ``_p``, else up to the first ``_w``."""
    cut = F.when(F.instr(row_id, "_p") > 0, F.substring_index(row_id, "_p", 1)).when(F.instr(row_id, "_w") > 0, F.substring_index(row_id, "_w", 1)).otherwise(row_id)
    return cut if doc is None else F.coalesce(doc, cut)


def paragraph_id(doc: Column, side: str, idx: Column) -> Column:
    """``doc#s0012`` for sources, ``doc#t0012`` for targets, ``doc#p0012`` by default."""
    return F.format_string(f"%s#{side}%04d", doc, idx)


def paragraph_index(c: Column) -> Column:
    return F.substring(F.substring_index(c, "#", -1), 2, 20).cast("int")


def user_prompt(source: Column, template: str) -> Column:
    """The template with ``{source}`` filled in literally."""
    head, _, tail = template.partition("{source}")
    return F.concat(F.lit(head), source, F.lit(tail))


def postprocess(c: Column) -> Column:
    """Model output without surrounding blanks, one fence around all of it, and a one-line preamble."""
    out = strip(text(c))
    out = F.regexp_replace(out, r"(?s)\A```[a-zA-Z]*\n(.*)\n```\z", "$1")
    return strip(F.regexp_replace(out, rf"(?U)\A(?:以下是|下面是)?(?:翻译|译文)[^\n]{{0,20}}[:：]{SPACE}*\n", ""))


def char_tokenize(c: Column) -> Column:
    """Code points joined by blanks."""
    return F.array_join(F.split(c, ""), " ")


def safe_name(c: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, underscore and dash become one underscore."""
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def count_of(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal.encode())).cast("int")


def share_of(c: Column, pattern: str) -> Column:
    """Matching characters per character; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(pattern)), F.length(c)), F.lit(0.0))


def cjk_ratio(c: Column) -> Column:
    return share_of(c, CJK)


def latin_ratio(c: Column) -> Column:
    return share_of(c, "[A-Za-z]")


def plain_text(c: Column) -> Column:
    """Prose without markup: code, constructs, addresses, heading and list marks, inline markers."""
    out = text(c)
    for pattern in (r"(?s)\{\{\{.*?\}\}\}", r"\[\[/?[^\]]*\]\]", rf"""(?U)https?://[^{_SPACES}\]|<>"']+""", rf"(?mdU)^{SPACE}*(\+{{1,6}}){SPACE}", rf"(?mdU)^{SPACE}*[>#*]{SPACE}+"):
        out = F.regexp_replace(out, pattern, " ")
    for marker in INLINE_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def whitespace_tokens(c: Column) -> Column:
    """The default token counter: words between white space."""
    return F.size(F.filter(F.split(text(c), r"\s+"), lambda w: w != ""))


def hash_fraction(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first eight bytes of SHA-1, read big-endian."""
    head = F.conv(F.substring(F.sha1(F.concat(F.lit(salt), key)), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)
