"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings, in SQL functions only.

Base kinds are patterns. The entropy kinds slide a window over each maximal run of their
character class: one count goes up and one goes down at each step, and the sum of c * log2(c)
follows from those two counts, so a step costs the same whatever the window, and a run as much as
it is long (about 6 microseconds a character). Windows at or above
the class's threshold merge into spans. A candidate is suppressed if it matches the allow-list
(words, numbers, slugs, UUIDs, placeholders); an entropy span that overlaps a base span is too.
That is what ``scan`` lists, by its SQL. ``redacted`` takes away more: all of an entropy span, also
where it joins a base span, a placeholder clears the windows that hold it, not the whole run, and a
candidate without a digit is left only if it is made of words: lower-case, capitalised or upper-case
ones between separators, or capitalised ones of four letters and more run together. What neither
finds is a random string of one case without digits or separators: it looks like a long word.

Spans are in code points, end exclusive, and cover whole matches. Defined results: a null text is
empty and has no spans; repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import other_columns, restored, text_or_empty

#: The base patterns: fixed values. Of assign, group 2 must have 8 characters or more.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE = 8


class EntropyClass(NamedTuple):
    kind: str
    alphabet: str
    pattern: str
    threshold: float


WINDOW = 20
#: Array elements that one step-by-step fold handles; longer arrays are folded stretch by stretch.
BITS = 8
STRETCH = 1 << BITS
CLASSES = (
    EntropyClass("entropy_hex", "0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 3.0),
    EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}", 3.9),
)
#: Candidates that are no secrets.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[a-z]+([-_/=+][a-z]+)*[-_/=+]?[0-9]{1,4}$",
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)(example|sample|placeholder|changeme|dummy|xxxx)",
)
#: The one of them that may be anywhere in a candidate.
PLACEHOLDER = ALLOWED[-1]
#: The same strings, written so that the pattern engine needs no stack: a group gives nothing back.
ALLOWED_HERE = tuple(p.replace("([-_/=+][a-z]+)*", "(?:[-_/=+][a-z]+)*+") for p in ALLOWED)
#: Of candidates without a digit, redaction leaves those made of lower-case, capitalised or upper-case words.
LETTERS_ONLY = ALLOWED[0]
WORDS_ONLY = r"^[-_/=+]*+(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]++|$))++$|^(?:[A-Z]?[a-z]{3,}+|[-_/=+])++$"
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stretches(values: Column) -> Column:
    """A non-empty array in arrays of up to STRETCH."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(values) - 1, BITS)), lambda b: F.slice(values, F.shiftleft(b, BITS) + 1, F.lit(STRETCH)))


def _sums(values: Column) -> Column:
    """Running sums of a non-empty array, stretch by stretch, so that no long array grows step by step."""

    def upto(x: Column, before: Column) -> Column:
        sums = F.aggregate(x, F.array(before), lambda out, y: F.concat(out, F.array(F.element_at(out, -1) + y)))
        return F.slice(sums, F.lit(2), F.size(x))

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda total, y: total + y))
        before = F.aggregate(whole, F.array(F.lit(0)), lambda out, y: F.concat(out, F.array(F.element_at(out, -1) + y)))
        return _let(before, lambda base: F.flatten(F.transform(parts, lambda x, b: upto(x, F.get(base, b)))))

    return _let(values, lambda v: _let(_stretches(v), joined))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the matches, left to right; value is the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gaps"))

    def hits(p: Column) -> Column:
        ends = _sums(F.transform(p["whole"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m)))
        one = lambda e, m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), F.get(p["value"], i).alias("value"))
        return _let(ends, lambda e: F.transform(p["whole"], lambda m, i: one(e, m, i)))

    return F.when(text.rlike(pattern), _let(parts, hits)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _hits(chunk: Column, base: Column, c: EntropyClass, window: int, but: str | None) -> Column:
    """Starts of the windows of a chunk (binary) at or above the threshold, ``base`` added.

    The counts of all characters are bit fields of a few longs: a step adds one and takes one away.
    """
    size = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    more = F.array(*(F.lit(b - a) for a, b in zip(size[:-1], size[1:], strict=True)))  # of n * log2(n), when n grows by one
    most = math.log2(window) * window - c.threshold * window + 1e-9  # of the sum of n * log2(n)
    width = window.bit_length()
    fields = 62 // width
    words = -(-len(c.alphabet) // fields)
    at = lambda code: F.struct(F.floor(code / fields).cast("int").alias("word"), (code % fields * width).cast("int").alias("shift"))
    codes = F.transform(F.split(chunk.cast("string"), ""), lambda x: at(F.instr(F.lit(c.alphabet), x) - 1))
    steps = _let(codes, lambda x: F.transform(x, lambda into, i: F.struct(into.alias("into"), F.get(x, i - window).alias("away"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("total"), F.lit(1 - window).alias("at"), F.array().cast("array<int>").alias("out"))
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])

    def step(acc: Column, e: Column) -> Column:
        into, away = e["into"], e["away"]
        change = F.when(into == away, F.lit(0.0)).otherwise(
            F.get(more, count(acc["counts"], into)) - F.when(away.isNotNull(), F.get(more, count(acc["counts"], away) - 1)).otherwise(F.lit(0.0))
        )
        counts = F.transform(
            acc["counts"], lambda x, k: x + F.when(k == into["word"], bit(into)).otherwise(F.lit(0).cast("long")) - F.when(k == away["word"], bit(away)).otherwise(F.lit(0).cast("long"))
        )
        total = acc["total"] + F.coalesce(change, F.lit(0.0))
        hit = (acc["at"] >= 0) & (total <= most)
        if but is not None:
            hit &= ~F.substring(chunk, acc["at"] + 1, F.lit(window)).cast("string").rlike(but)
        out = F.when(hit, F.concat(acc["out"], F.array(base + acc["at"]))).otherwise(acc["out"])
        return F.struct(counts.alias("counts"), total.alias("total"), (acc["at"] + 1).alias("at"), out.alias("out"))

    return F.aggregate(steps, start, step)["out"]


def _windows(value: Column, c: EntropyClass, window: int, but: str | None = None) -> Column:
    """Merged intervals, relative to the candidate, of the windows at or above the threshold that do not match ``but``.

    A candidate (ASCII) is read in chunks of STRETCH windows, so that time and memory grow with its length only.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def hits(raw: Column) -> Column:
        n = F.octet_length(raw) - window
        begins = F.when(n >= 0, F.sequence(F.lit(0), F.shiftright(n, BITS))).otherwise(F.array().cast("array<int>"))

        def of(b: Column) -> Column:
            return _let(F.substring(raw, F.shiftleft(b, BITS) + 1, F.lit(STRETCH + window - 1)), lambda chunk: _hits(chunk, F.shiftleft(b, BITS), c, window, but))

        return F.flatten(F.transform(begins, of))

    def merged(at: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) > F.get(at, i - 1) + window))
        last = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(at)) - 1
        one = lambda f, i, k: F.struct(F.get(at, i).alias("start"), (F.get(at, last(f, k)) + window).alias("end"))
        return F.when(F.size(at) > 0, _let(fresh, lambda f: F.transform(f, lambda i, k: one(f, i, k)))).otherwise(none)

    return _let(_let(value.cast("binary"), hits), merged)


def _entropy(text: Column, c: EntropyClass, window: int, whole: bool) -> Column:
    allowed = [WORDS_ONLY, *(p for p in ALLOWED_HERE if p not in (PLACEHOLDER, LETTERS_ONLY))] if whole else ALLOWED_HERE
    candidates = F.filter(_found(text, c.pattern), lambda m: ~m["value"].rlike("|".join(f"(?:{p})" for p in allowed)))

    def spans(m: Column) -> Column:
        return F.transform(
            _windows(m["value"], c, window, PLACEHOLDER if whole else None),
            lambda s: F.struct((m["start"] + s["start"]).alias("start"), F.lit(KINDS.index(c.kind)).alias("rank"), (m["start"] + s["end"]).alias("end"), F.lit(c.kind).alias("kind")),
        )

    return F.flatten(F.transform(candidates, spans))


def _scanned(docs: DataFrame, window: int, whole: bool = False) -> DataFrame:
    """row (the columns but text), text, base and spans; if ``whole``, no entropy span goes for a base span or a placeholder elsewhere."""
    text = F.col("text")
    docs = docs.select(other_columns(docs), text_or_empty().alias("text"))
    assign = F.filter(_found(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    docs = docs.select("row", "text", F.array_sort(F.concat(_spans(assign, "assign"), _spans(_found(text, ACCESS), "access"), _spans(_found(text, HEX), "hex"))).alias("base"))
    added = docs.select("row", "text", "base", F.concat(*(_entropy(text, c, window, whole) for c in CLASSES)).alias("added"))
    free = F.col("added") if whole else F.filter("added", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return added.select("row", "text", F.col("base").cast(SPAN).alias("base"), F.array_sort(F.concat("base", free)).cast(SPAN).alias("spans"))


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, base and spans of every row: arrays of (start, rank, end, kind), sorted; spans holds base too."""
    found = _scanned(docs.select(F.col("doc_id").cast("long"), "text"), window)
    return found.select("row.doc_id", "text", "base", "spans")


def redacted(docs: DataFrame, window: int = WINDOW, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by the mark, and n_chars counted again where it changed; a null text stays null."""
    found = _scanned(docs.select("*", F.col("text").isNull().alias("_no_text")), window, whole=True)
    changed = F.size("spans") > 0
    text = F.when(F.col("row._no_text"), F.lit(None)).otherwise(redact(F.col("text"), F.col("spans"), mark))
    out = found.select("row", changed.alias("changed"), text.alias("text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", n))
    return restored(out, docs)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones merged, replaced by the mark."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    closed = lambda acc: F.when(acc["end"] > acc["start"], F.concat(acc["out"], F.array(F.struct(acc["start"], acc["end"])))).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        joins = (acc["end"] > acc["start"]) & (s["start"] < acc["end"])
        start = F.when(joins, acc["start"]).otherwise(s["start"])
        end = F.when(joins, F.greatest(acc["end"], s["end"])).otherwise(s["end"])
        return F.struct(start.alias("start"), end.alias("end"), F.when(joins, acc["out"]).otherwise(closed(acc)).alias("out"))

    def page(part: Column, first: Column) -> Column:
        """Text from ``first`` to the last span of a stretch, cut from the whole text once."""

        def pieces(cut: Column) -> Column:
            before = lambda i: F.coalesce(F.get(part, i - 1)["end"], first)
            return F.array_join(F.transform(part, lambda s, i: F.concat(F.substring(cut, before(i) - first + 1, s["start"] - before(i)), F.lit(mark))), "")

        return _let(F.substring(text, first + 1, F.element_at(part, -1)["end"] - first), pieces)

    def written(cover: Column) -> Column:
        pages = _let(_stretches(cover), lambda parts: F.transform(parts, lambda p, b: page(p, F.coalesce(F.element_at(F.get(parts, b - 1), -1)["end"], F.lit(0)))))
        return F.concat(F.array_join(pages, ""), F.substring(text, F.element_at(cover, -1)["end"] + 1, F.length(text)))

    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out"))
    return F.when(F.size(spans) > 0, _let(F.aggregate(spans, empty, step, closed), written)).otherwise(text)
