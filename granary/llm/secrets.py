"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs that every match needs.
Postings of the queries' trigrams are built per block of rows, about BLOCK rows each by a hash of the row, so that a
posting list is bounded; each block's postings are intersected and united to candidates. Only candidates are verified
with the expression itself. A rule without a mandatory trigram scans every text.

Trigrams are taken from lower-cased text; folding can add candidates and lose none.

Spans are leftmost and do not overlap within a kind; matches that fail a rule's length are dropped afterwards. Null
texts count as empty. Repeated rows each get their spans; null ids are ids like others. Very long texts are searched
whole; redacting one takes time in proportion to its length and its secrets. An empty table gives an empty result. A
column of the table that is named found is replaced; no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre  # the parser's names for a pattern's parts
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import starts
from .common import attach, materialize

#: Rows a block of postings has on average, and candidates up to which their list is broadcast.
BLOCK = 2048
BROADCAST_ROWS = 200_000
#: Bounds of the derivation: strings that a part may stand for, and ANDs that a query may have.
MOST_STRINGS, MOST_TERMS = 64, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern in which the given group has least characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: Fixed values of the contract, then kinds that this scanner adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|[\r\nA-Za-z0-9+/=]*)", 0, 1),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

Terms = frozenset[frozenset[str]]
ALL: Terms = frozenset([frozenset()])


def _absorbed(terms: Iterable[frozenset[str]]) -> Terms:
    """An OR of ANDs without those that another one implies; ALL if it grows too long."""
    found = set(terms)
    found = {t for t in found if not any(o < t for o in found)}
    return frozenset(found) if len(found) <= MOST_TERMS else ALL


def _and(a: Terms, b: Terms) -> Terms:
    joined = _absorbed(x | y for x in a for y in b)
    return a if joined == ALL and b != ALL else joined


def _needs(strings: frozenset[str]) -> Terms:
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _class(items: list) -> frozenset[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _derive(parts: Iterable) -> tuple[frozenset[str] | None, Terms]:
    """(all strings that the parts match, or None if they are many; what a match needs)."""
    exact: frozenset[str] | None = frozenset([""])
    run, needs = frozenset([""]), ALL
    for op, value in parts:
        strings: frozenset[str] | None = None
        inner = ALL
        if op is sre.LITERAL:
            strings = frozenset([chr(value).lower()])
        elif op is sre.IN:
            strings = _class(value)
        elif op is sre.SUBPATTERN:
            strings, inner = _derive(value[-1])
        elif op is sre.BRANCH:
            sides = [_derive(side) for side in value[1]]
            if all(s is not None for s, _ in sides):
                strings = frozenset().union(*(s for s, _ in sides))
            inner = _absorbed(t for _, terms in sides for t in terms)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            once, need = _derive(body)
            inner = need if low else ALL
            if once is not None and (low, high) == (0, 1):
                strings = once | {""}
            elif once is not None and low == high == 1:
                strings = once
        joined = frozenset(a + b for a in run for b in strings) if strings is not None and len(run) * len(strings) <= MOST_STRINGS else None
        if joined is None:
            needs, run, exact = _and(_and(needs, _needs(run)), inner), frozenset([""]), None
            if strings is not None:
                run = strings
        else:
            run = joined
            needs = _and(needs, inner) if strings is None else needs
    exact = run if exact is not None else None
    return exact, _and(needs, _needs(run))


def trigram_query(pattern: str) -> Terms:
    """The OR of ANDs of lower-case trigrams that every match of a pattern holds; ALL if there is no mandatory one."""
    return _derive(_parser.parse(pattern))[1]


def _row_key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.col(id_col), text)


def _present(text: Column, trigrams: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))


def _evaluate(query: Terms, trigrams: list[str]) -> Column:
    """Rows of a block whose postings satisfy a query; postings: a map of trigram number to rows."""
    none = F.array().cast("array<bigint>")
    posting = lambda t: F.coalesce(F.element_at("postings", F.lit(trigrams.index(t))), none)
    found = none
    for term in sorted(map(sorted, query)):
        rows = posting(term[0])
        for t in term[1:]:
            rows = F.array_intersect(rows, posting(t))
        found = F.array_union(found, rows)
    return found


def candidates(lowered: DataFrame, queries: dict[str, Terms], trigrams: list[str], rows: int) -> DataFrame:
    """(row, kinds) of the rows whose postings satisfy a kind's query; lowered: (row, low)."""
    blocks = max(1, rows // BLOCK)
    present = lowered.select("row", F.explode(_present(F.col("low"), trigrams)).alias("trigram"))
    index = present.groupBy(F.pmod("row", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("row").alias("rows"))
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("postings"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _evaluate(q, trigrams).alias("rows")) for k, q in queries.items()])
    met = by_block.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.rows").alias("row"))
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule's matches as an array of (start, rank, end, kind)."""
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    shown = _bounded(rule)
    pattern = F.lit(shown)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = matches if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def place(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, shown, -1), lambda g: F.length(g).cast("long")), 1, F.size(found))
        lengths = F.transform(found, lambda m: F.length(m).cast("long"))
        before = starts(F.flatten(F.zip_with(gaps, lengths, lambda g, n: F.array(g, n))))
        spans = F.transform(found, lambda m, i: F.struct(F.get(before, 2 * i + 1).alias("start"), F.lit(order).alias("rank"), (F.get(before, 2 * i + 1) + F.length(m)).alias("end"), F.lit(rule.kind).alias("kind")))
        long = F.zip_with(spans, measured, lambda s, m: F.when(F.length(m) >= rule.least, s))
        return F.filter(long, lambda s: s.isNotNull()).cast(kind)

    return F.when(F.size(matches) == 0, F.array().cast(kind)).otherwise(F.transform(F.array(matches), place)[0])


def _run_least(rule: Rule) -> int:
    """For a pattern of fixed characters and a last class taken once or more: that class's least count, else 0.

    Such a match is a maximal run, so asking for the length within the pattern drops the same matches as afterwards.
    """
    parts = list(_parser.parse(rule.pattern))
    if rule.pattern.endswith("+") and all(op is sre.LITERAL for op, _ in parts[:-1]) and parts[-1][0] is sre.MAX_REPEAT:
        return max(0, rule.least - len(parts) + 1)
    return 0


def _bounded(rule: Rule) -> str:
    """The pattern, with its least length inside where that is the same."""
    least = _run_least(rule)
    return rule.pattern.removesuffix("+") + f"{{{least},}}" if least else rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with found: the sorted spans of every text as an array of (start, rank, end, kind)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALL}
    trigrams = sorted({t for q in indexed.values() for term in q for t in term})
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows travel as one struct, so no column of theirs can clash with those of the scan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text.alias("_text"), _row_key(id_col, text).alias("_row"))
    none = F.array().cast("array<string>")
    if not indexed:
        held = rows.withColumn("_kinds", none)
    else:
        total = docs.count()
        table = materialize(candidates(rows.select(F.col("_row").alias("row"), F.lower("_text").alias("low")), indexed, trigrams, total), "candidates")
        if table.count() <= BROADCAST_ROWS:
            found = F.broadcast(table.select(F.col("row").alias("_met"), F.col("kinds").alias("_kinds")))
            held = rows.join(found, F.col("_row") == F.col("_met"), "left").drop("_met")
        else:
            # Only rows with a trigram of the index can be candidates; the others go round the shuffle. A row that is
            # repeated often is dealt by attach, which wants to know how often.
            some = F.size(_present(F.lower("_text"), trigrams)) > 0
            often = rows.filter(some).groupBy(F.col("_row").alias("row")).agg(F.count("*").alias("rows"))
            known = materialize(table.join(often, "row").select(F.col("row").alias("_row"), F.col("kinds").alias("_kinds"), "rows"), "candidates-counted")
            near = attach(rows.filter(some).withColumn("_spread", F.monotonically_increasing_id()), known, ["_row"], ["_kinds"], "rows", total, "_spread").drop("_spread")
            held = near.unionByName(rows.filter(~some).withColumn("_kinds", F.lit(None).cast("array<string>")))
    held = held.withColumn("_kinds", F.coalesce("_kinds", none))
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    each = []
    for order, rule in enumerate(rules):
        spans = spans_of(F.col("_text"), rule, order)
        each.append(F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(F.array().cast(kind)) if rule.kind in indexed else spans)
    own = [F.col("_doc")[c].alias(c) for c in docs.columns if c != "found"]
    # Spans come first in a step of their own: within one, names in lambdas could mean the columns that are given back.
    return held.withColumn("_found", F.sort_array(F.concat(*each))).select(*own, F.col("_found").alias("found"))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one, which has the kind of the first."""
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"

    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.size(held) == 0, F.array(new)).when(s["start"] > last["end"], F.concat(held, F.array(new))).otherwise(F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(joined)))

    return F.aggregate(spans, F.array().cast(kind), lambda held, s: add(held, s).cast(kind))


def redact(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """scanned with just the found spans replaced, by [REDACTED:kind]; texts without one stay as they are.

    Spans of several kinds that overlap or touch are replaced as one, under the kind of the first.
    """
    text = F.col(f"`{text_col}`")

    def rebuilt(held: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(held, i - 1)["end"])
            return F.concat(F.substring(text, begin + 1, s["start"] - begin), F.lit("[REDACTED:"), s["kind"], F.lit("]"))

        rest = F.substring(text, F.element_at(held, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(held, part), ""), rest)

    clean = F.transform(F.array(merged(F.col("found"))), rebuilt)[0]
    return scanned.withColumn(text_col, F.when(F.size("found") > 0, clean).otherwise(text))
