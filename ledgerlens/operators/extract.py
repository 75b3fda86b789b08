"""Extraction operators: named sections (T3-T5), amounts near labels
(T6-T9), keyword in context (T17).

Everything is a Column expression evaluated where the text is read: the
regex work runs in the scan stage, in parallel over documents, and only
the (much smaller) extracted values travel further.

Sections, labels and keywords share one scan. ``pattern_hits`` marks, in a
single regex pass, every position where one of several patterns matches: at
such a position each pattern is tried in a look-ahead of its own, so patterns
may overlap, and the replacement writes what each of them captured between two
control characters (U+0001 to U+0003; where a text holds them itself, it is
read with U+FFFD in their place, which keeps every position). They are ASCII,
so that the JVM keeps marked ASCII texts in one byte a character. Splitting at
the marks gives a position table, and all further choices (the last start, the
first end after it, windows, nearest amounts) are arithmetic on it.

Values used more than once are bound once through a single-element lambda
(``_bind``), so no regex pass is evaluated twice.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import PY_WS_LITERAL, normalize_ws_sql, py_regex, py_strip

M1 = "\x01"
M2 = "\x02"
M3 = "\x03"
# what else equals an ASCII letter where Java ignores case in Unicode
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
FLAGS_I = "(?iud)"      # case-insensitive (Unicode), '.' stops only at \n
FLAGS_IM = "(?iudm)"    # plus MULTILINE anchors


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def java_pattern(p: str, multiline: bool = False) -> str:
    return (FLAGS_IM if multiline else FLAGS_I) + py_regex(p)


# ------------------------------------------------------------------ one scan
# The expressions below are nested array functions. They are put together as
# SQL text and parsed once: built call by call, each would cost hundreds of
# round trips to the JVM.
def _lit(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if value is None else str(value)


def _let(name: str, value: str, body: str) -> str:
    """SQL: evaluate ``value`` once under a name that ``body`` uses. The fold of
    no elements hands the value on as it is; ``transform`` would copy it, and
    each level of names all that lies below."""
    return f"aggregate(array()::array<int>, {value}, ({name}, no_element) -> {name}, {name} -> {body})"


def _apply(text, body: str) -> Column:
    """``body``, SQL over a text named ``t``, of a column."""
    return F.call_function("aggregate", F.expr("array()::array<int>"), _c(text), F.expr("(t, no_element) -> t"), F.expr(f"t -> {body}"))


def literal_start(pattern: str) -> str | None:
    """The letters that every match of a pattern starts with; None for a
    pattern of alternatives or one that starts otherwise."""
    word = re.match(r"[a-z]+(?![a-z?*{])", pattern)
    flat = re.sub(r"\\.|\[[^]]*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", flat)) != flat:
        flat = inner
    return word.group() if word and "|" not in flat else None


def hit_slots(patterns: Sequence[str]) -> list[list[int]]:
    """Patterns whose first letters differ never match at one position: they
    share a slot of the scan, one look-ahead with one set of captures. Each
    slot holds at most one pattern of a letter, in the patterns' order."""
    starts = [literal_start(p) for p in patterns]
    if not all(starts):
        return [[k] for k in range(len(patterns))]
    slots: list[list[int]] = []
    for k, w in enumerate(starts):
        nth = sum(v[0] == w[0] for v in starts[:k])
        slots[nth:nth + 1] = [[*slots[nth], k] if nth < len(slots) else [k]]
    return slots


def _letters(letter: str) -> str:
    """All characters that equal an ASCII letter where case is ignored."""
    return letter + letter.upper() + FOLDED.get(letter, "")


def _pattern_no(patterns: Sequence[str], slot: str, label: str) -> str:
    """SQL: the pattern of a match by its slot and first character."""
    slots = hit_slots(patterns)
    if all(len(of) == 1 for of in slots):
        return slot
    every = "".join(_letters(c) for c in sorted({p[0] for p in patterns}))
    of = [next((str(k) for k in ks if c in _letters(patterns[k][0])), "-1") for ks in slots for c in every]
    return f"get(array({', '.join(of)}), {slot} * {len(every)} + instr('{every}', left({label}, 1)) - 1)"


def hits_regex(patterns: Sequence[str], after: int, flags: str, tail: tuple[str, int] | None = None) -> tuple[str, str]:
    """(regex, replacement) of the one scan. The regex matches the empty string
    wherever a pattern does and captures, per slot (see ``hit_slots``), match
    and text after it, or what the groups of ``tail`` (regex, their number) do;
    the replacement is a mark and all captures, those of a slot closed by a mark
    and parted by a third."""
    if after:
        tail = "((?s:.{0," + str(after) + "}))", 1
    follow, groups = tail or ("", 0)
    starts = [literal_start(p) for p in patterns]
    if all(starts):
        every = "".join(sorted(set("".join(_letters(w[0]) for w in starts))))
        gate = f"(?=(?-iu:[{every}]))(?={'|'.join(sorted(set(starts)))})"
    else:
        gate = "(?=" + "|".join(f"(?:{py_regex(p)})" for p in patterns) + ")"
    parts, out, group = [gate], M1, 1
    for ks in hit_slots(patterns):
        own = sum(re.compile(patterns[k]).groups for k in ks)
        label = "|".join(f"(?:{py_regex(patterns[k])})" if len(ks) > 1 else py_regex(patterns[k]) for k in ks)
        parts.append(f"(?=({label}){follow}|)")
        out += M3.join(f"${g}" for g in (group, *range(group + own + 1, group + own + 1 + groups))) + M2
        group += own + 1 + groups
    return flags + "".join(parts), out


def _running(n: str, block: int = 64) -> str:
    """SQL: for an array, the sums of all earlier elements, element by element.
    In blocks, since a running sum that is appended to copies all it has so
    far: the work is linear but for the list of blocks."""
    total = "aggregate({}, 0, (p, q) -> p + q)"
    blocks = f"transform(sequence(0, (size({n}) - 1) div {block}), bk -> slice({n}, int(bk) * {block} + 1, {block}))"
    starts = ("aggregate(bs, named_struct('at', 0, 'of', array()::array<int>), (acc, bl) -> named_struct("
              f"'at', acc.at + {total.format('bl')}, 'of', array_append(acc.of, acc.at)), acc -> acc.of)")
    inner = f"transform(bl, (e, j) -> get(so, i) + {total.format('slice(bl, 1, j)')})"
    few = f"aggregate(slice({n}, 1, greatest(size({n}) - 1, 0)), array(0), (sums, e) -> array_append(sums, element_at(sums, -1) + e))"
    many = _let("bs", blocks, _let("so", starts, f"flatten(transform(bs, (bl, i) -> {inner}))"))
    return f"if(size({n}) <= {block}, {few}, {many})"


def _hits(text: str, patterns: Sequence[str], before: int = 0, after: int = 0, flags: str = FLAGS_IM, made=None,
          tail: tuple[str, int, int] | None = None) -> str:
    """SQL of ``pattern_hits`` over the text ``text``; with ``made``, a function
    from the SQL of pattern, position, match and text after it, a row is the
    struct that it gives, so that the long texts after the matches go no
    further. With ``tail`` (see ``hits_regex``, and a number of characters) that
    function gets pattern, position, captures and, where the text holds marker
    characters, its own match and that many characters after it."""
    regex, out = hits_regex(patterns, after, flags, tail and tail[:2])
    marked = "(" + " OR ".join(f"contains({text}, '{m}')" for m in (M1, M2, M3)) + ")"
    plain = f"if(mk, translate({text}, '{M1}{M2}{M3}', '\ufffd\ufffd\ufffd'), {text})"
    per = 1 + (tail[1] if tail else 1 if after else 0)
    caught = [f"get(lr, {i})" for i in range(per)] if per > 1 else ["get(fi, k)"]
    label, rest = caught[0], caught[1] if after else "''"
    no = _pattern_no(patterns, "k", label)
    at = "length(get(sg, 0)) + get(ru, c)"
    # a text with marker characters gives its own characters back, by position
    def cut(value: str, start: str) -> str:
        return f"if(mk, substring({text}, {start}, length({value})), {value})"
    fields = [f"'no', {no}", f"'position', {at}", f"'label', {cut(label, f'{at} + 1')}"]
    if before:
        # the end of the text since the position before, or of the last few
        # such texts, none of which is empty
        few = f"array_join(slice(be, greatest(c + 2 - {before}, 1), least(c + 1, {before})), '')"
        last = f"right(if(length(get(be, c)) >= {before}, get(be, c), {few}), {before})"
        fields.append(f"'before', if(mk, substring({text}, greatest({at} - {before}, 0) + 1, least({at}, {before})), {last})")
    if after:
        fields.append(f"'after', {cut(rest, f'{at} + length({label}) + 1')}")
    row = f"named_struct({', '.join(fields)})"
    if tail:
        row = made(no, at, caught, f"if(mk, substring({text}, {at} + 1, length({label}) + {tail[2]}), NULL)")
    elif made:
        row = made(no, at, cut(label, f"{at} + 1"), cut(rest, f"{at} + length({label}) + 1"))
    held = "get(fi, k) != ''"
    if per > 1:
        row, held = _let("lr", f"split(get(fi, k), '{M3}', -1)", row), f"left(get(fi, k), 1) != '{M3}'"
    found = f"transform(filter(ks, k -> {held}), k -> {row})"
    last = f"substring_index(s, '{M2}', -1)"
    table = f"flatten(transform(fs, (s, c) -> {_let('fi', f"split(s, '{M2}', -1)", found)}))"
    table = _let("ru", _running("le"), table)
    if before:
        table = _let("be", f"concat(slice(sg, 1, 1), transform(fs, s -> {last}))", table)
    table = _let("ks", f"sequence(0, {len(hit_slots(patterns)) - 1})", table)
    table = _let("fs", "slice(sg, 2, size(sg) - 1)", _let("le", f"transform(fs, s -> length({last}))", table))
    return _let("mk", marked, _let("sg", f"split(regexp_replace({plain}, {_lit(regex)}, {_lit(out)}), '{M1}', -1)", table))


def pattern_hits(text, patterns: Sequence[str], before: int = 0, after: int = 0, flags: str = FLAGS_IM) -> Column:
    """The position table of several patterns from one scan of a text:
    array<struct<no, position, label[, before][, after]>> in order of position
    (0-based), then of the pattern. Every position where a pattern matches is
    there, so matches of one pattern may overlap; ``before`` and ``after``
    characters around a match come with it."""
    return _apply(text, _hits("t", patterns, before, after, flags))


def _disjoint(hits: str, chars: str = "length({}.label)") -> str:
    """SQL: one pattern's hits without those that start inside an earlier one
    that stays, i.e. the matches of a plain scan. Patterns whose matches never
    overlap, as nearly all, cost one look at neighbours. ``chars`` is the SQL
    of a hit's length."""
    apart = ("forall(sequence(1, size(dj) - 1), i -> get(dj, i).position >= "
             f"get(dj, i - 1).position + {chars.format('get(dj, i - 1)')})")
    scan = ("aggregate(dj, named_struct('end', 0, 'of', slice(dj, 1, 0)), (acc, x) -> if(x.position >= acc.end, "
            f"named_struct('end', x.position + {chars.format('x')}, 'of', array_append(acc.of, x)), acc), acc -> acc.of)")
    return _let("dj", hits, f"if(size(dj) < 2 OR {apart}, dj, {scan})")


# ------------------------------------------------------------------ T4
def _section(starts: Sequence[int], ends: Sequence[int], min_chars: int, fallback_chars: int | None) -> str:
    """SQL: the section by positions in the text ``u`` with hits ``h``: for
    each start pattern in order its last match, from which each end pattern in
    order gives the text up to its first match after the start, then all that
    follows (or its first ``fallback_chars``); the first candidate that is
    long enough."""
    def accept(chars: str) -> str:
        return _let("cand", normalize_ws_sql(f"substring(u, la.position + 1, {chars})"), f"if(length(cand) > {min_chars}, cand, NULL)")

    inside = "la.position + length(la.label)"
    cands = [_let("en", f"get(filter(h, x -> x.no = {e} AND x.position >= {inside}), 0).position",
                  f"if(en IS NULL, NULL, {accept('en - la.position')})") for e in ends]
    cands.append(accept("length(u)" if fallback_chars is None else str(fallback_chars)))
    found = [_let("la", f"try_element_at({_disjoint(f'filter(h, x -> x.no = {st})')}, -1)",
                  f"if(la IS NULL, NULL, coalesce({', '.join(cands)}))") for st in starts]
    return f"coalesce({', '.join(found)})"


def sections_by_position(text, sections: Sequence[str],
                         patterns: Mapping[str, Mapping[str, Sequence[str]]] = C.SECTION_PATTERNS,
                         min_chars: int = C.SECTION_MIN_CHARS, fallback_chars: int | None = None) -> Column:
    """T4 for several sections: array<struct<section, section_text>> in the
    order given, from one scan for all their start and end patterns.
    ``section_text`` is NULL where nothing is found, and for an unknown
    section."""
    every: list[str] = []
    found = []
    for s in sections:
        value = "CAST(NULL AS STRING)"
        if patterns.get(s):
            n = len(every)
            k = n + len(patterns[s]["start"])
            every += [*patterns[s]["start"], *patterns[s]["end"]]
            value = _section(range(n, k), range(k, len(every)), min_chars, fallback_chars)
        found.append(f"named_struct('section', {_lit(s)}, 'section_text', {value})")
    body = f"array({', '.join(found)})"
    if every:
        body = _let("h", _hits("u", every, flags=FLAGS_I), body)
    # section texts hold no private-use U+E000 / U+E001
    marks = "if(contains(t, '\ue000') OR contains(t, '\ue001'), translate(t, '\ue000\ue001', '\ufffd\ufffd'), t)"
    return _apply(text, _let("u", marks, body))


def extract_section(text, section: str,
                    patterns: Mapping[str, Mapping[str, Sequence[str]]] = C.SECTION_PATTERNS,
                    min_chars: int = C.SECTION_MIN_CHARS,
                    fallback_chars: int | None = None) -> Column:
    """T4: the first acceptable candidate over the start patterns in order,
    NULL when none (or for an unknown section)."""
    return F.get(sections_by_position(text, [section], patterns, min_chars, fallback_chars), 0)["section_text"]


def extract_sections(df: DataFrame, text: str = "text", sections: Sequence[str] = C.SECTIONS,
                     keep: Sequence[str] | None = None,
                     patterns: Mapping[str, Mapping[str, Sequence[str]]] = C.SECTION_PATTERNS,
                     min_chars: int = C.SECTION_MIN_CHARS,
                     fallback_chars: int | None = None) -> DataFrame:
    """T4 for several sections at once, long output (keys, section,
    section_text). The text is scanned once for all sections."""
    keep = [c for c in (keep or df.columns) if c != text]
    found = sections_by_position(F.col(text), sections, patterns, min_chars, fallback_chars)
    return df.select(*keep, F.inline(found))


# ------------------------------------------------------------------ T5
def headers_found(text, pattern: str = C.HEADER_PATTERN, scan_chars: int | None = None,
                  first: int | None = None, shown: int | None = None) -> Column:
    """T5: the item headers of the text, de-duplicated in order. The study's
    diagnostic scan stops at 50,000 characters, 15 hits and 8 shown; these
    limits are arguments here, off by default."""
    t = _c(text) if scan_chars is None else F.substring(_c(text), 1, scan_chars)
    hits = F.regexp_extract_all(t, F.lit(java_pattern(pattern)), 0)
    hits = F.array_distinct(hits if first is None else F.slice(hits, 1, first))
    return hits if shown is None else F.slice(hits, 1, shown)


def extraction_status(sections: DataFrame, text_present: str = "has_text",
                      cached: str | None = None) -> DataFrame:
    """G7 input: status per (key, section): cached (already written, where
    the column ``cached`` is given) / no_html / ok / failed."""
    done = F.coalesce(F.col(cached), F.lit(False)) if cached else F.lit(False)
    st = (F.when(done, "cached").when(~F.col(text_present), "no_html")
          .when(F.col("section_text").isNotNull(), "ok").otherwise("failed"))
    return sections.withColumn("status", st)


# ------------------------------------------------------------------ T6 / T7
def _first_number(window: str, number_pattern: str, min_value: float) -> str:
    """SQL: struct<raw, v> of the first number token >= min_value in a window.

    Fast path: the first token alone (``regexp_extract`` stops at the first
    match), which is the answer whenever it is large enough. Only when it
    is not (a footnote marker, a day of month) the window is scanned in
    full; ``if`` evaluates that branch lazily. A window without a token is
    not scanned again."""
    start = f"(?={C.NUMBER_START})" if number_pattern == C.NUMBER_PATTERN else ""
    num, least = _lit(py_regex(start + number_pattern)), f"CAST({float(min_value)} AS DOUBLE)"

    def value(raw: str) -> str:
        return f"try_cast(replace(regexp_extract({raw}, {num}, 1), ',', '') AS DOUBLE)"
    every = f"transform(regexp_extract_all({window}, {num}, 0), r -> named_struct('raw', r, 'v', {value('r')}))"
    every = f"get(filter({every}, y -> y.v >= {least}), 0)"
    first = _let("fv", value("fr"), f"if(fv >= {least}, named_struct('raw', fr, 'v', fv), {every})")
    none = f"fr = ''{'' if start else ' AND false'}"
    return _let("fr", f"regexp_extract({window}, {num}, 0)", f"if({none}, NULL, {first})")


def _strip(text: str) -> str:
    """SQL of ``py_strip``: blanks first, the whole set only where an end still
    needs it, since a trim of many characters looks at every one of the text."""
    ws = _lit(PY_WS_LITERAL)
    return _let("st", f"trim({text})", f"if(contains({ws}, left(st, 1)) OR contains({ws}, right(st, 1)), btrim(st, {ws}), st)")


def _numbers(text: str, labels: Sequence[str], window: int = C.NUMBER_WINDOW, number_pattern: str = C.NUMBER_PATTERN,
             min_value: float = C.NUMBER_MIN_VALUE, context_after: int = C.CONTEXT_AFTER,
             context_max: int | None = None, values_only: bool = False) -> str:
    """SQL of ``numbers_near_labels``. Every hit gets its number where it is
    found; what follows handles short rows only."""
    def made(no: str, at: str, label: str, after: str) -> str:
        fields = [f"'no', {no}", f"'position', {at}", f"'chars', length({label})",
                  "'value', if(contains(b.raw, '(') AND contains(b.raw, ')'), -b.v, b.v)"]
        if not values_only:
            ctx = _strip(f"replace(concat({label}, substring(w, 1, {context_after})), '\n', ' ')")
            ctx = ctx if context_max is None else f"substring({ctx}, 1, {context_max})"
            fields += [f"'raw', if(b IS NULL, NULL, {_strip('b.raw')})", f"'context', if(b IS NULL, NULL, {ctx})"]
        return _let("w", after, _let("b", _first_number("w", number_pattern, min_value), f"named_struct({', '.join(fields)})"))

    def numbered(match_no: str) -> str:
        more = "" if values_only else ", 'raw', x.raw, 'context', x.context, 'position', x.position"
        return f"named_struct('pattern_no', x.no, 'match_no', {match_no}, 'value', x.value{more})"
    # few matches, none inside another of its pattern: a match's number is its
    # distance from the first row of its pattern
    apart = ("forall(sequence(1, size(h) - 1), i -> get(h, i).no != get(h, i - 1).no OR "
             "get(h, i).position >= get(h, i - 1).position + get(h, i - 1).chars)")
    nth = "if(i = 0 OR get(hn, i - 1) != x.no, 0, int(i + 1 - array_position(hn, x.no)))"
    few = _let("hn", "h.no", f"transform(h, (x, i) -> {numbered(nth)})")
    own = _disjoint("filter(h, z -> z.no = pn)", "{}.chars")
    many = f"flatten(transform(array_distinct(h.no), pn -> transform({own}, (x, i) -> {numbered('i')})))"
    found = f"if(size(h) < 2 OR (size(h) <= 64 AND {apart}), {few}, {many})"
    return _let("h", f"sort_array({_hits(text, labels, after=window, made=made)})", f"filter({found}, m -> m.value IS NOT NULL)")


def numbers_near_labels(text, labels: Sequence[str], **kw) -> Column:
    """T6 for several label patterns from one scan of the text:
    array<struct<pattern_no, match_no, value, raw, context, position>> by
    pattern, then match: one per label match that has a number >=
    ``min_value`` within ``window`` characters after it. The closest (first)
    such number is kept, negative when its token holds both '(' and ')'. The
    context is the label and the ``context_after`` characters after it, cut to
    ``context_max`` where given (the study: 100); position is the label's
    0-based offset. ``values_only`` leaves out the last three."""
    return _apply(text, _numbers("t", labels, **kw))


def _near_number() -> str:
    """What follows a label in the scan of ``number_rows``, in three groups: the
    context after it without the blanks at its end; the number, where it stands near and is of the usual form;
    else the whole window, to be searched by itself.

    The way to the number leads over text without tokens and over tokens of one
    digit. All runs are bounded: 28 pieces of at most 16 characters and a number
    of at most 52 end beyond no window, so the first number in the window is the
    same. Anything longer or odd (leading zeros, other digits than ASCII's)
    leaves its window."""
    assert C.NUMBER_WINDOW >= 28 * 16 + 52 and C.NUMBER_MIN_VALUE == 10
    start, end = r"[\($]?\s{0,3}+\$?\s{0,3}+", r"(?:\s{0,2}+\)|(?!\s*+\)))"
    decimals = r"(?:\.[0-9]{1,3}+(?!\d)|(?!\.\d))"
    digit = rf"{start}\d(?!\d|,\d{{3}}){decimals}{end}"
    plain = r"[^\($\s\d]{1,16}+|(?![\($]?\s*+\$?\s*+\d)[\($\s]"
    grouped = r"[1-9][0-9]{0,2}(?:,[0-9]{3}){1,6}(?!,\d{3})"
    whole = r"(?!\d{1,3},\d{3})[1-9][0-9]{1,14}+(?!\d)"
    number = rf"\s{{0,9}}+((?!\s){start}(?:{grouped}|{whole}){decimals}{end})"
    context = rf"(?=((?s:.{{0,{C.CONTEXT_AFTER}}}){py_regex(r'(?<!\s)')}|))"
    return (context + py_regex(rf"(?:(?:{plain}|{digit}){{0,28}}+{number}")
            + rf"|((?s:.{{0,{C.NUMBER_WINDOW}}})))")


def number_rows(df: DataFrame, text: str, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """T6 as rows (``keep``, pattern_no, match_no, value, raw, context,
    position), the elements of ``numbers_near_labels`` by its defaults.

    The scan takes the number with its label. The matches then leave their text
    as short rows, and what is done to each is plain columns, which Spark
    compiles; in an array's lambdas they are interpreted node by node."""
    num = py_regex(f"(?={C.NUMBER_START})" + C.NUMBER_PATTERN)
    names = ("label", "after", "near", "window")

    def made(no: str, at: str, caught: Sequence[str], own: str) -> str:
        of = ", ".join(f"'{name}', {value}" for name, value in zip(names, caught))
        return f"named_struct('no', {no}, 'match_no', 0, 'position', {at}, {of}, 'own', {own})"
    # a match counts where it does not start inside an earlier one of its pattern
    short = "transform(h, (x, i) -> named_struct('no', x.no, 'position', x.position, 'chars', length(x.label), 'i', i))"
    apart = _disjoint("filter(hs, z -> z.no = pn)", "{}.chars")
    same = ", ".join(f"'{name}', get(h, x.i).{name}" for name in (*names, "own"))
    nth = f"named_struct('no', x.no, 'match_no', n, 'position', x.position, {same})"
    again = _let("hs", short, f"flatten(transform(array_distinct(hs.no), pn -> transform({apart}, (x, n) -> {nth})))")
    found = _let("h", _hits("t", labels, tail=(_near_number(), 3, C.NUMBER_WINDOW), made=made),
                 _let("hn", "h.no", f"if(size(array_distinct(hn)) = size(hn), h, {again})"))
    x = df.select(*keep, F.inline(_apply(text, found)))

    def value(raw: Column) -> Column:
        return F.replace(F.regexp_extract(raw, num, 1), F.lit(","), F.lit("")).try_cast("double")
    near, whole = F.col("near") != "", F.col("own").isNotNull()
    window = F.when(whole, F.substring("own", F.length("label") + 1, F.length("window"))).otherwise(F.col("window"))
    first = F.get(F.filter(F.regexp_extract_all(window, F.lit(num), F.lit(0)), lambda r: value(r) >= F.lit(float(C.NUMBER_MIN_VALUE))), 0)
    x = x.where(near | first.isNotNull())
    context = F.replace(F.when(whole, F.substring("own", F.lit(1), F.length("label") + C.CONTEXT_AFTER)).otherwise(F.concat("label", "after")),
                        F.lit("\n"), F.lit(" "))
    # ``after`` ends in no blank; a first character between ' ' and DEL is none
    stripped = ~whole & (F.col("after") != "") & (F.left("label", F.lit(1)) > " ") & (F.left("label", F.lit(1)) < "\x7f")
    x = x.select(*keep, F.col("no").alias("pattern_no"), "match_no", "position", F.when(near, F.col("near")).otherwise(py_strip(first)).alias("raw"),
                 F.when(stripped, context).otherwise(py_strip(context)).alias("context"))
    signs = F.contains(F.lit("($"), F.left("raw", F.lit(1))) | F.endswith("raw", F.lit(")"))
    digits = F.when(signs, F.btrim("raw", F.lit("($)" + PY_WS_LITERAL))).otherwise(F.col("raw"))
    v = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    negative = F.contains("raw", F.lit("(")) & F.contains("raw", F.lit(")"))
    return x.select(*keep, "pattern_no", "match_no", F.when(negative, -v).otherwise(v).alias("value"), "raw", "context", "position")


def numbers_near_label(text, label: str, **kw) -> Column:
    """T6 on one label pattern (see ``numbers_near_labels``)."""
    return numbers_near_labels(text, [label], **kw)


def _first_largest(found: str) -> str:
    """SQL, T7: a strictly larger |value| replaces the present best."""
    return _let("fl", found, "aggregate(fl, get(fl, 0), (acc, x) -> if(abs(x.value) > abs(acc.value), x, acc))")


def best_value(text, patterns: Sequence[str], **kw) -> Column:
    """Over a field's patterns in order, the first match with the
    largest |value| (a strictly larger value from a later pattern wins)."""
    return _apply(text, _first_largest(_numbers("t", patterns, **kw)))


# ------------------------------------------------------------------ T8 / T9
def unit_heads(text, scans: Sequence[int] | None = None) -> list[Column]:
    """The lower-cased text that unit detection scans: all of it, or the
    prefixes ``scans`` in turn (the study: 10,000, then 50,000 characters)."""
    if scans is None:
        return [F.lower(_c(text))]
    return [F.lower(F.substring(_c(text), 1, n)) for n in scans]


def deciding_units(patterns: Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    """The unit patterns without those that can not decide: where one holds an
    earlier pattern whole, with nothing but more text around it, a text that
    it matches has met the earlier one already."""
    kept: list[tuple[str, int]] = []
    for p, m in patterns:
        if not any(k in p and not re.search(r"[|\[(]", p.replace(k, "").replace("\\(", "")) for k, _ in kept):
            kept.append((p, m))
    return kept


def unit_multiplier_from_heads(heads: Sequence[Column],
                               patterns: Sequence[tuple[str, int]] = tuple(C.UNIT_PATTERNS)) -> Column:
    levels = []
    for head in heads:
        expr = None
        for p, mult in deciding_units(patterns):
            cond = head.rlike(py_regex(p))
            expr = F.when(cond, F.lit(mult)) if expr is None else expr.when(cond, F.lit(mult))
        levels.append(expr)
    return F.coalesce(*levels, F.lit(1)).cast("long")


def unit_multiplier(text, patterns: Sequence[tuple[str, int]] = tuple(C.UNIT_PATTERNS),
                    scans: Sequence[int] | None = None) -> Column:
    """The first pattern in priority order that occurs in the
    lower-cased text (or in its prefixes ``scans`` in turn) gives the
    multiplier; 1 when none."""
    return unit_multiplier_from_heads(unit_heads(text, scans), patterns)


def scrape_filing(df: DataFrame, html: str = "html", keep: Sequence[str] | None = None,
                  fields: Mapping[str, Sequence[str]] = C.FIELD_PATTERNS, text_is_html: bool = True) -> DataFrame:
    """Filing -> wide row of line items (value x unit multiplier, NULL
    when not found). The text is made once and scanned once for the labels of
    all fields; each field takes its best match."""
    from ..functions.text import html_to_text_financial
    keep = [c for c in (keep or df.columns) if c != html]
    t = html_to_text_financial(F.col(html)) if text_is_html else F.col(html)
    labels = [p for pats in fields.values() for p in pats]
    x = df.select(*keep, t.alias("_text"))
    x = x.select(*keep, unit_multiplier("_text").alias("unit_multiplier"),
                 numbers_near_labels("_text", labels, values_only=True).alias("_numbers"))
    found, first = [], 0
    for f, pats in fields.items():
        lo, first = first, first + len(pats)
        own = _first_largest(f"filter(_numbers, m -> m.pattern_no >= {lo} AND m.pattern_no < {first})")
        found.append(F.expr(f"({own}).value * unit_multiplier").alias(f))
    return x.select(*keep, "unit_multiplier", *found)


# ------------------------------------------------------------------ T17
def keywords_in_context(text, terms: Sequence[str], before: int = 20, after: int = 50, shown: int | None = None,
                        max_chars: int | None = None) -> Column:
    """T17 for several terms from one scan: array<struct<term, n_matches,
    snippets>> in the order given. A snippet is ``before`` characters, the
    match and ``after`` characters, trimmed. The study shows 3 snippets of 80
    characters; ``shown`` and ``max_chars`` give that, off by default."""
    cut = f"btrim(concat(x.before, x.label, x.after), {_lit(PY_WS_LITERAL)})"
    cut = cut if max_chars is None else f"substring({cut}, 1, {max_chars})"
    some = "kw" if shown is None else f"slice(kw, 1, {shown})"
    made = [_let("kw", _disjoint(f"filter(h, z -> z.no = {k})"), (
        f"named_struct('term', {_lit(term)}, 'n_matches', size(kw), 'snippets', transform({some}, x -> {cut}))"))
        for k, term in enumerate(terms)]
    return _apply(text, _let("h", _hits("t", list(terms), before, after, FLAGS_I), f"array({', '.join(made)})"))


def keyword_in_context(text, term: str, before: int = 20, after: int = 50, shown: int | None = None,
                       max_chars: int | None = None) -> tuple[Column, Column]:
    """T17 of one term: (count of case-insensitive matches by a plain count,
    snippets as in ``keywords_in_context``)."""
    count = F.regexp_count(_c(text), F.lit(java_pattern(term)))
    return count, F.get(keywords_in_context(text, [term], before, after, shown, max_chars), 0)["snippets"]
