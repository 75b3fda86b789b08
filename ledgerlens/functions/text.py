"""Column builders for text: HTML cleanup, whitespace, words, terms, sentences.

All builders are pure Column expressions (JVM side, whole-stage codegen);
no Python runs per row.

Regex dialect: the study's patterns are Python ``str`` regexes (Unicode
``\\s``, ``.`` stops only at ``\\n``). Java needs ``(?U)`` for Unicode classes
and ``(?d)`` so that ``.``/``$`` see only ``\\n``. Python's whitespace set
(``str.split``/``strip``/``\\s``) also holds U+001C..U+001F, which Java's
``\\s`` lacks, so word and trim logic uses the explicit class ``WS``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Python's str.isspace() set, written so that both Java and RE2 accept it
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_CHARS + "]"
NON_WS = "[^" + WS_CHARS + "]"
# The same set for Java only: the Unicode White_Space property plus
# U+001C..U+001F. Two class tests instead of a long union: much faster.
JWS_CHARS = r"\p{IsWhite_Space}\x1C-\x1F"
JWS = "[" + JWS_CHARS + "]"
NON_JWS = "[^" + JWS_CHARS + "]"

# Java flags that give Python str-regex semantics
PY_FLAGS = "(?Ud)"
PY_FLAGS_I = "(?iUd)"
PY_FLAGS_IM = "(?iUmd)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_CLASS_SUBST = {"s": (WS, WS_CHARS), "d": (r"\p{Nd}", r"\p{Nd}"),
                "w": (r"[\p{L}\p{N}_]", r"\p{L}\p{N}_")}
_CLASS_SUBST_JAVA = dict(_CLASS_SUBST, s=(JWS, JWS_CHARS))


def py_regex(pattern: str, dialect: str = "java") -> str:
    """Spell Python's Unicode ``\\s``, ``\\d`` and ``\\w`` as explicit classes
    with the same meaning in Java (``dialect='java'``) or RE2
    (``dialect='re2'``); inside a ``[...]`` class the members are inlined."""
    subst = _CLASS_SUBST_JAVA if dialect == "java" else _CLASS_SUBST
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in subst:
                out.append(subst[nxt][1 if in_class else 0])
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


# the same set as literal characters, for the non-regex ``btrim``
PY_WS_LITERAL = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(col) -> Column:
    """str.strip(): remove leading and trailing Python whitespace (a
    character-set trim, no regex)."""
    return F.btrim(_c(col), F.lit(PY_WS_LITERAL))


# ---------------------------------------------------------------- T1 / T2 / T3
FIN_BLOCK_TAGS, SECTION_BLOCK_TAGS = C.FIN_BLOCK_TAGS, C.SECTION_BLOCK_TAGS


def html_steps(block_tags: str, dialect: str = "java") -> list[tuple[str, str, bool]]:
    """The cleanup steps with their block tags, in a regex dialect (a step
    without classes reads the same in all)."""
    return [(py_regex(p, dialect) if "\\" in p and "[" not in p else p, r, ci)
            for p, r, ci in ((p.replace("BLOCK", block_tags), r, ci) for p, r, ci in C.HTML_STEPS)]


def _html_common(c: Column, block_tags: str) -> Column:
    """The steps of ``html_steps`` in two passes over a text, four where it
    holds an ``&amp;``.

    Neighbouring steps with one replacement are one alternation: no match of
    one holds or touches a part of the other's, and what is put in (a newline, a
    blank) is in none. Only ``&amp;`` -> ``&`` makes text that later steps read
    (``&amp;lt;``), so what stands before and after it is merged just without
    one. Runs are possessive: a loop in Java, not a call per element. Literal
    first characters stand outside the case-insensitive part."""
    lines = f"<(?iu:br{JWS}*/?|/(?:{py_regex(block_tags)}))>"
    tag, nbsp = "<[^>]+>", "&(?iu:nbsp);"
    blank, entity = "[ \\t\u00a0]", r"&(?:[a-zA-Z]+|#\p{Nd}+);"
    broken = F.regexp_replace(c, lines, "\n")
    # a single blank before other text stays as it is
    some = "(?=[ \\t\u00a0<&])(?! [^ \\t\u00a0<&])"
    plain = F.regexp_replace(broken, f"{some}(?:{blank}|{tag}|{entity}|{nbsp})++", " ")
    untagged = F.regexp_replace(F.regexp_replace(broken, f"{tag}|{nbsp}", " "), "&(?iu:amp);", "&")
    twice = F.regexp_replace(untagged, f"{some}(?:{blank}|{entity})++", " ")
    return F.when(c.rlike("&(?iu:amp;)"), twice).otherwise(plain)


def html_to_text_financial(col) -> Column:
    """HTML -> text for line-item search (td closes a line, no trim)."""
    return _html_common(_c(col), FIN_BLOCK_TAGS)


def html_to_text_section(col) -> Column:
    """HTML -> text for section search (blank-line runs -> one blank
    line, trimmed; td does not close a line)."""
    c = _html_common(_c(col), SECTION_BLOCK_TAGS)
    c = F.regexp_replace(c, f"\n{JWS}*\n", "\n\n")
    return py_strip(c)


# whitespace runs that a collapse to one space actually changes: two or more
# characters, or a single character other than ' '
_WS_TO_COLLAPSE = f"{JWS}{{2,}}|[{JWS_CHARS}&&[^ ]]"


def normalize_ws(col) -> Column:
    """Every whitespace run -> one space, trimmed.

    Only runs that change are rewritten (single spaces, the vast majority,
    are left alone); afterwards the ends hold at most one plain space, which
    ``trim`` removes."""
    return F.trim(F.regexp_replace(_c(col), _WS_TO_COLLAPSE, " "))


def normalize_ws_sql(text: str) -> str:
    """``normalize_ws`` as SQL text over the SQL expression ``text``."""
    pattern = _WS_TO_COLLAPSE.replace("\\", "\\\\")
    return f"trim(regexp_replace({text}, '{pattern}', ' '))"


# ---------------------------------------------------------------- T10 / T11
def word_count(col) -> Column:
    """Whitespace tokens; NULL for a missing or empty text, 0 for a
    blanks-only text."""
    c = _c(col)
    return (F.when(c.isNull() | (c == F.lit("")), F.lit(None).cast("long"))
            .otherwise(F.regexp_count(c, F.lit(f"{NON_JWS}+")).cast("long")))


def _literal_count(lowered: Column, term: str) -> Column:
    t = term.lower()
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit(""))))
            / F.lit(len(t))).cast("long")


def term_count(col, terms: Iterable[str], word_boundary: bool = False,
               lowered: bool = False) -> Column:
    """Case-insensitive sum of non-overlapping substring counts.

    ``lowered=True`` means ``col`` is already lower-cased (stage it once per
    row when several term lists are counted). ``word_boundary=True`` counts
    whole-word hits instead (an option the study does not use)."""
    lowered = _c(col) if lowered else F.lower(_c(col))
    parts = []
    for term in terms:
        if word_boundary:
            parts.append(F.regexp_count(
                lowered, F.lit(r"(?U)\b" + _quote(term.lower()) + r"\b")).cast("long"))
        else:
            parts.append(_literal_count(lowered, term))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def density(count: Column, words: Column, per: float) -> Column:
    """count / words * per, 0 when there are no words."""
    return F.when(words > 0, count / words * F.lit(per)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- T14 / T15
def split_sentences(col, pattern: str = C.SENTENCE_SPLIT) -> Column:
    """Array of stripped, non-empty sentences."""
    java = PY_FLAGS + pattern.replace(r"\s", JWS)
    parts = F.split(_c(col), java)
    return F.filter(F.transform(parts, lambda s: py_strip(s)), lambda s: s != F.lit(""))


def boilerplate_regex(prefixes: Iterable[str] = C.BOILERPLATE_PREFIXES) -> str:
    return PY_FLAGS_I + "^(?:" + "|".join(py_regex(p) for p in prefixes) + ")"


def is_quality_sentence(col,
                        min_words: int = C.SENTENCE_MIN_WORDS,
                        max_words: int = C.SENTENCE_MAX_WORDS,
                        min_alpha: float = C.SENTENCE_MIN_ALPHA,
                        prefixes: Iterable[str] = C.BOILERPLATE_PREFIXES) -> Column:
    """Enough words, mostly letters, no boilerplate opening."""
    s = _c(col)
    n_words = F.regexp_count(s, F.lit(f"{NON_JWS}+"))
    n_alpha = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    total = F.length(s)
    alpha_ok = (total == 0) | (n_alpha / total >= F.lit(min_alpha))
    return (n_words.between(min_words, max_words) & alpha_ok
            & ~s.rlike(boilerplate_regex(prefixes)))
