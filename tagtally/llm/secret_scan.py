"""Secret scans in SQL expressions only: three fixed patterns, and sliding-window entropy over candidate strings.

Offsets of matches come from running totals of the lengths of a text's matches and of the gaps between them
(``regexp_extract_all`` and ``split`` agree on both), so everything stays in one narrow projection without a shuffle.
Every step is linear in a text: no fold carries a result that grows with it (``_sql``).

The entropy method looks at maximal candidate strings (``CANDIDATE``). A string belongs to the narrowest character
class that holds all of its characters; each class has a threshold of Shannon entropy in bits for windows of
``WINDOW`` characters. Counts stand packed in six 64-bit words, five bits a character. Sliding a window by one
character adds one and takes one away there, which changes two terms of the running sum of ``c * log2(c)``, and the
entropy follows from the sum. A long string is cut into pieces that begin with the last window of the piece before.
Windows over the threshold merge to spans. Strings that are on the allow-list as a whole, and spans inside a span of
the fixed patterns, are suppressed. A placeholder word suppresses no more than its part of a merged span, which ends
at ``/`` and ``=`` and ``NEAR`` characters from the word; what is left of the span is judged again by its own windows.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; texts are scanned
whole, whatever their length; repeated rows give repeated results; all columns of the input stay as they are, unless
one is named like an output, which then gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtally.llm._sql import let, part, pieces, running

# The patterns, their least lengths, and the kinds in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole match has 18 characters or more, which only the longest run can have
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Characters of a string that one fold goes over, and counters of five bits that a 64-bit word holds.
STRETCH, PACKED = 256, 12
#: Class by pattern, narrowest first, and its least entropy; runs of digits or of letters alone are never secrets here.
CLASSES = [(r"^[0-9]+$", None), (r"^[A-Za-z_-]+$", None), (r"^[0-9a-f]+$", 3.0), (r"^[0-9A-F]+$", 3.0), (r"^[0-9a-z]+$|^[0-9A-Z]+$", 3.6), (r"^[0-9A-Za-z]+$", 3.8), (r"", 3.9)]
#: Words of placeholders and runs of the alphabet, and how many characters beside a word go with it.
PLACEHOLDER, NEAR = r"example|sample|dummy|placeholder|changeme|redacted|x{6,}|0{8,}|1234567890|abcdefghij", 40
#: Strings that look random but are known not to be secrets: placeholders, then whole identifiers and words in paths.
#: A string is on a list if all of an entry's patterns are found; none of them nests repetitions, so that long strings
#: need no deep matching.
ALLOW = [
    [f"(?i){PLACEHOLDER}"],
    [r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"],
    [r"^[a-z0-9][a-z0-9/_=-]*[a-z0-9]$", r"[/_=-]", r"^(?!(?s:.*?)[a-z0-9]{15})"],
    [r"^[+/_=-]+$"],
]
_SPANS = "array<struct<start:int,end:int,body:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _matches(text: str, pattern: str, tag: str, group: int = 0, gaps: bool = False) -> str:
    """SQL for the matches of a pattern as ``start, end, body``: the match or a group of it; or the gaps around them."""
    p = _quoted(pattern)
    lengths = f"zip_with(slice(g_{tag}, 1, size(m_{tag})), m_{tag}, (x, y) -> length(x) + length(y))"
    at = f"l_{tag}[i]"
    if gaps:
        made = f"transform(g_{tag}, (x, i) -> named_struct('start', {at}, 'end', {at} + length(x), 'body', x))"
    else:
        body = "x" if not group else f"k_{tag}[i]"
        made = f"transform(m_{tag}, (x, i) -> named_struct('start', {at} + length(g_{tag}[i]), 'end', {at} + length(g_{tag}[i]) + length(x), 'body', {body}))"
    made = let(running(lengths, "+", "0", tag), f"l_{tag}", made)
    if group:
        made = let(f"regexp_extract_all({text}, {p}, {group})", f"k_{tag}", made)
    return let(f"regexp_extract_all({text}, {p}, 0)", f"m_{tag}", let(f"split({text}, {p}, -1)", f"g_{tag}", made))


def _found(text: str, pattern: str, where: Column, least: int, tag: str, group: int = 0) -> Column:
    spans = f"filter({_matches(text, pattern, tag, group)}, x -> length(x.body) >= {least})"
    return F.when(where, F.expr(f"cast({spans} as {_SPANS})")).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _stretch(codes: str, floor: str, base: str) -> str:
    """SQL for the hot spans of one stretch of a string, by a fold over its characters with counts in packed words."""
    terms = "array(" + ",".join(["0D"] + [f"{c * math.log2(c)!r}D" for c in range(1, WINDOW + 2)]) + ")"
    words = -(-len(ALPHABET) // PACKED)
    one = lambda c: f"shiftleft(1L, cast(5 * ({c} % {PACKED}) as int))"
    count = lambda c: f"cast(shiftright(acc.w[cast({c} div {PACKED} as int)], cast(5 * ({c} % {PACKED}) as int)) & 31 as int)"
    c, d = f"{codes}[i]", f"{codes}[i - {WINDOW}]"
    entered = f"acc.s + get({terms}, {count(c)} + 1) - get({terms}, {count(c)})"
    # Two steps a character: an even one moves the window, an odd one judges it.
    moved = f"""if(i >= {WINDOW} and {c} = get({codes}, i - {WINDOW}), acc, named_struct(
        'w', transform(acc.w, (n, k) -> n + if(k = {c} div {PACKED}, {one(c)}, 0L) - if(i >= {WINDOW} and k = get({codes}, i - {WINDOW}) div {PACKED}, {one(d)}, 0L)),
        's', if(i >= {WINDOW}, {entered} + get({terms}, {count(d)} - 1) - get({terms}, {count(d)}), {entered}), 'from', acc.from, 'to', acc.to, 'out', acc.out))"""
    push = f"if(acc.to > 0, array_append(acc.out, named_struct('start', cast({base} + acc.from as int), 'end', cast({base} + acc.to as int))), acc.out)"
    judged = f"""if(i >= {WINDOW - 1} and {math.log2(WINDOW)!r}D - acc.s / {WINDOW}D >= {floor},
        if(acc.to > i - {WINDOW},
            named_struct('w', acc.w, 's', acc.s, 'from', acc.from, 'to', i + 1, 'out', acc.out),
            named_struct('w', acc.w, 's', acc.s, 'from', i - {WINDOW - 1}, 'to', i + 1, 'out', {push})),
        acc)"""
    step = f"if(j % 2 = 0, {let('cast(j div 2 as int)', 'i', moved)}, {let('cast(j div 2 as int)', 'i', judged)})"
    zero = f"named_struct('w', array_repeat(0L, {words}), 's', 0D, 'from', -1, 'to', -1, 'out', cast(array() as array<struct<start:int,end:int>>))"
    return f"aggregate(sequence(0, 2 * size({codes}) - 1), {zero}, (acc, j) -> {step}, acc -> {push})"


def _windows(body: str, floor: str, start: str) -> str:
    """SQL for the spans of ``body`` whose windows have an entropy of ``floor`` bits or more, moved by ``start``."""
    codes = f"transform(split(concat(if(k > 0, right(cut[k - 1], {WINDOW - 1}), ''), piece), ''), x -> locate(x, '{ALPHABET}') - 1)"
    base = f"{start} + k * {STRETCH} - if(k > 0, {WINDOW - 1}, 0)"
    found = f"flatten(transform(cut, (piece, k) -> {let(codes, 'codes', _stretch('codes', floor, base))}))"
    # Spans of neighbouring stretches that touch are one: ends stand where the next span begins apart.
    first = "filter(hot, (x, i) -> i = 0 or get(hot, i - 1).end < x.start)"
    last = "filter(hot, (x, i) -> i = size(hot) - 1 or get(hot, i + 1).start > x.end)"
    merged = f"zip_with({first}, {last}, (a, b) -> named_struct('start', a.start, 'end', b.end))"
    return let(f"regexp_extract_all({body}, r'.{{1,{STRETCH}}}', 0)", "cut", let(found, "hot", merged))


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``secrets``: an array of ``struct(start, end, kind)`` by start, then kind."""
    text = "__t"
    low = F.lower(F.col(text))
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | low.contains(word)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]).alias("__row"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias(text))
    rows = rows.select(
        "__row",
        _found(text, ASSIGN, named, 12, "assign", 2).alias("__assign"),
        _found(text, ACCESS, F.col(text).contains("AKIA"), 18, "access").alias("__access"),
        _found(text, HEX, F.col(text).rlike("[0-9a-f]{16}"), 16, "hex").alias("__hex"),
        _found(text, CANDIDATE, F.col(text).rlike(CANDIDATE.replace(",}", "}")), WINDOW, "all").alias("__all"),
    )
    judge = "CASE " + " ".join(f"WHEN x.body rlike {_quoted(p)} THEN {'cast(null as double)' if t is None else f'{t!r}D'}" for p, t in CLASSES if p) + f" ELSE {CLASSES[-1][1]!r}D END"
    allowed = " or ".join("(" + " and ".join(f"x.body rlike {_quoted(p)}" for p in listed) + ")" for listed in ALLOW[1:])
    rows = rows.withColumn("__all", F.expr(f"filter(transform(__all, x -> named_struct('start', x.start, 'body', x.body, 'floor', if({allowed}, cast(null as double), {judge}))), x -> x.floor is not null)"))
    # A span without a placeholder word stays; of another one the parts beside the words are judged again.
    word = _quoted(ALLOW[0][0])
    near = f"[^/=]{{0,{NEAR}}}(?i:{PLACEHOLDER})[^/=]{{0,{NEAR}}}"
    beside = f"filter({_matches('z.body', near, 'beside', gaps=True)}, v -> length(v.body) >= {WINDOW})"
    again = f"flatten(transform({beside}, v -> {_windows('v.body', 'y.floor', 'z.start + v.start')}))"
    spans = f"transform({_windows('y.body', 'y.floor', '0')}, z -> named_struct('start', y.start + z.start, 'end', y.start + z.end, 'body', {part('cuts', 'z.start', '(z.end - z.start)')}))"
    kept = f"flatten(transform({let(pieces('y.body'), 'cuts', spans)}, z -> if(z.body rlike {word}, {again}, array(named_struct('start', z.start, 'end', z.end)))))"
    rows = rows.withColumn("__all", F.expr(f"flatten(transform(__all, y -> {kept}))"))
    ranked = ", ".join(f"transform({c}, x -> named_struct('start', x.start, 'rank', {i + 1}, 'end', x.end))" for i, c in enumerate(["__assign", "__access", "__hex", "__all"]))
    # By start, then kind: an entropy span goes if some base span before it in this order ends no earlier.
    reach = running("transform(z, x -> if(x.rank < 4, x.end, -1))", "greatest", "-1", "reach")
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    named_spans = f"transform(filter(z, (x, i) -> x.rank < 4 or far[i] < x.end), x -> named_struct('start', x.start, 'end', x.end, 'kind', {kinds}[x.rank - 1]))"
    return rows.select("__row.*", F.expr(let(f"array_sort(concat({ranked}))", "z", let(reach, "far", named_spans))).alias("secrets"))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, counts by kind, a digest of the spans of the fixed patterns, and all spans."""
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(secrets, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return scan(docs.select(id_column, text_column), text_column).select(
        id_column, *map(count, KINDS),
        F.sha2(F.expr(joined.format("filter(secrets, x -> x.kind <> 'entropy')")), 256).alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with the union of each text's spans replaced by ``mask``; other texts stay as they are."""
    rows = scan(docs, text_column)
    text = f"`{text_column}`"
    # A span that begins before the greatest end so far belongs to the union before it.
    begins = "filter(transform(secrets, (x, i) -> named_struct('start', x.start, 'after', far[i])), x -> x.start >= x.after)"
    gaps = f"transform({begins}, x -> concat({part('held', 'x.after', '(x.start - x.after)')}, '{mask}'))"
    tail = part("held", "element_at(far, -1)", f"(length({text}) - element_at(far, -1))")
    ends = running("transform(secrets, x -> x.end)", "greatest", "0", "ends")
    cut = let(ends, "far", let(pieces(text), "held", f"concat(array_join({gaps}, ''), {tail})"))
    made = F.when(F.size("secrets") > 0, F.expr(cut)).otherwise(F.col(text))
    return rows.select(*[made.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns if c != "secrets"])
