"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a match must
satisfy: literals give the conjunction of their trigrams, alternatives a disjunction, a repetition of at least
one what its element gives, and anything else nothing. The index holds, for every trigram of these queries and every
block of documents, the list of the documents that have it. Lists are intersected and united block by block, so
none grows with the corpus. Candidates are verified with the expression over the whole text. A rule without a
mandatory trigram scans all texts.

All of it is built-in functions; expressions are in the syntax that Java's and RE2's engines share.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm import store


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one stays if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for ``word`` with letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    # The whole block if nothing but its lines comes before the end mark, else the header.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
)


# A trigram query is True (no condition), a trigram, or ("and" | "or", parts).
def _both(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(text: str) -> object:
    return _both("and", [text[k : k + 3] for k in range(len(text) - 2)])


class _Parser:
    """Reads a regular expression into the set of its exact strings, or a query where those are too many.

    A value is ``(strings, query)``: all strings it can match if these are few, else None and what any match
    must contain. Strings are in lower case, as the index is.
    """

    MOST = 16

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def parse(self) -> object:
        strings, query = self._either()
        return query if strings is None else _both("or", [_grams(s) for s in strings])

    def _either(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        if all(s is not None for s, _ in parts):
            return list(dict.fromkeys(x for s, _ in parts for x in s)), True
        return None, _both("or", [q if s is None else _both("or", [_grams(x) for x in s]) for s, q in parts])

    def _sequence(self):
        run: list[str] = [""]  # exact strings since the last gap
        found: list = []
        gap = False
        while (c := self._peek()) is not None and c not in "|)":
            strings, query = self._repeated()
            many = None if strings is None else list(dict.fromkeys(a + b for a in run for b in strings))
            if many is not None and len(many) <= self.MOST:
                run = many
                continue
            found += [_both("or", [_grams(x) for x in run]), query if strings is None else _both("or", [_grams(x) for x in strings])]
            run, gap = [""], True
        if not gap:
            return run, True
        return None, _both("and", [*found, _both("or", [_grams(x) for x in run])])

    def _repeated(self):
        strings, query = self._atom()
        c = self._peek()
        least, most = 1, 1
        if c == "?":
            least, most = 0, 1
        elif c == "*":
            least, most = 0, None
        elif c == "+":
            least, most = 1, None
        elif c == "{" and (m := re.match(r"\{(\d+)(,?)(\d*)\}", self.p[self.at :])):
            least, most = int(m[1]), int(m[3]) if m[3] else (None if m[2] else int(m[1]))
            self.at += len(m[0]) - 1
        else:
            return strings, query
        self.at += 1
        if self._peek() in ("?", "+"):
            self.at += 1
        if (least, most) == (0, 1) and strings is not None:
            return ["", *strings], True
        if least == 0:
            return None, True
        return None, query if strings is None else _both("or", [_grams(s) for s in strings])

    def _atom(self):
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            if self.p.startswith("?:", self.at):
                self.at += 2
            elif self._peek() == "?":
                raise ValueError(f"group not understood: {self.p}")
            out = self._either()
            self.at += 1
            return out
        if c == "[":
            end = self.p.index("]", self.at + 1)
            inner, self.at = self.p[self.at : end], end + 1
            if inner[0] != "^" and "-" not in inner[1:-1] and "\\" not in inner:
                return list(dict.fromkeys(x.lower() for x in inner)), True
            return None, True
        if c == "\\":
            c = self.p[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return [chr(int(self.p[self.at - 2 : self.at], 16)).lower()], True
            return (None, True) if c.isalnum() else ([c], True)
        return (None, True) if c in ".^$" else ([c.lower()], True)

    def _peek(self) -> str | None:
        return self.p[self.at] if self.at < len(self.p) else None


def trigram_query(pattern: str) -> object:
    """What the lower-cased text of any match contains: True, a trigram or a tree of "and" and "or"."""
    return _Parser(pattern).parse()


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else {t for p in query[1] for t in _trigrams(p)}


def _evaluated(query: object, lists: dict[str, Column]) -> Column:
    """The documents of a block that satisfy ``query``."""
    if isinstance(query, str):
        return lists[query]
    kind, parts = query
    join = F.array_intersect if kind == "and" else F.array_union
    return reduce(join, (_evaluated(p, lists) for p in parts))


#: Documents of a block of the index, about.
BLOCK = 512
#: As many candidates are broadcast at most; more are joined by a shuffle.
FEW = 500_000


def candidates(docs: DataFrame, rules: Sequence[Rule], rows: int | None = None) -> DataFrame:
    """``(doc, kinds)``: hash of each document that satisfies the trigram query of some rule, and those rules.

    ``docs(doc, text)``; bit k of ``kinds`` stands for rule k. A block takes about ``BLOCK`` documents of near
    hashes, whatever the corpus' size, since its number is as many leading bits of the hash as ``rows`` needs.
    """
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    queries = {k: q for k, q in queries.items() if q is not True}
    grams = sorted(set().union(*map(_trigrams, queries.values()))) if queries else []
    if not grams:
        return docs.select("doc", F.lit(0).cast("long").alias("kinds")).limit(0)
    bits = max(1, ((docs.count() if rows is None else rows) // BLOCK).bit_length())
    low = docs.select("doc", F.lower("text").alias("text"))
    has = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("text"), g))
    postings = low.select(F.shiftrightunsigned("doc", 64 - bits).alias("block"), F.explode(has).alias("gram"), "doc")
    postings = postings.groupBy("block", "gram").agg(F.collect_set("doc").alias("docs"))  # one block's documents at most
    none = F.array().cast("array<long>")
    blocks = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("lists"))
    lists = {g: F.coalesce(F.element_at("lists", g), none) for g in grams}
    found = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("kind"), _evaluated(q, lists).alias("docs")) for k, q in queries.items()))
    hits = blocks.select(F.explode(found).alias("x")).select("x.kind", F.explode("x.docs").alias("doc"))
    return hits.groupBy("doc").agg(F.bit_or("kind").alias("kinds"))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def sums_before(numbers: Column) -> Column:
    """For each of ``numbers`` (array of long) the sum of those before it.

    Sums are taken in blocks of about the square root of the array's size, and of the blocks before; so the work
    grows with the size to the power of one and a half, and no array grows by one element at a time.
    """

    def of(x: Column) -> Column:
        n, wide = F.size(x["all"]), x["wide"]
        upto = lambda k: F.filter(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), lambda i: i < k)
        totals = F.transform(upto(F.ceil(n / wide).cast("int")), lambda b: _total(F.slice(x["all"], b * wide + 1, wide)))
        heads = _bound(totals, lambda t: F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b))))

        def inside(h: Column) -> Column:
            block = lambda b: F.slice(x["all"], b * wide + 1, wide)
            return F.flatten(F.transform(h, lambda head, b: _bound(block(b), lambda part: F.transform(part, lambda _, k: head + _total(F.slice(part, F.lit(1), k))))))

        return F.when(n == 0, F.array().cast("array<long>")).otherwise(_bound(heads, inside))

    wide = lambda a: F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
    return _bound(_bound(numbers, lambda a: F.struct(a.alias("all"), F.greatest(wide(a), F.lit(1)).alias("wide"))), of)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, order, end, kind>>`` of the matches that stay, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    group = (lambda m: m) if rule.group == 0 else (lambda m: F.regexp_extract(m, rule.pattern, rule.group))
    # The text is gap, match, gap, match ..., gap: starts are sums of lengths.
    sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), (F.length(group(m)) >= rule.least).alias("stays")))
    whole = F.filter(sizes, lambda x: x["size"].isNotNull())

    def placed(all_: Column) -> Column:
        before = sums_before(F.transform(all_, lambda x: x["gap"] + x["size"]))

        def one(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.when(x["stays"], F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))

        return F.array_compact(F.zip_with(all_, before, one))

    return _bound(whole, placed)


SPANS = "array<struct<start:long,order:int,end:long,kind:string>>"


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with a column ``spans``: array of (start, order, end, kind), sorted.

    A null text counts as empty and has no span. Positions are code points of the whole text. Repeated rows are
    scanned each and every column is kept, but a ``spans`` of the input is replaced; an empty table gives no
    rows. Texts stay where they are while there are few candidates, whose hashes are then broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__doc", F.xxhash64("doc_id", "text"))
    found = store.save(candidates(keyed.select(F.col("__doc").alias("doc"), text.alias("text")), rules), "candidates")
    found = found.withColumnsRenamed({"doc": "__doc", "kinds": "__kinds"})
    both = keyed.join(F.broadcast(found) if found.count() <= FEW else found, "__doc", "left")
    parts = []
    for k, rule in enumerate(rules):
        scanned = trigram_query(rule.pattern) is True
        wanted = F.rlike(text, F.lit(rule.pattern)) if scanned else F.coalesce(F.col("__kinds").bitwiseAND(1 << k) != 0, F.lit(False))
        parts.append(F.when(wanted, spans_of(text, rule, k)).otherwise(F.array().cast(SPANS)))
    out = both.withColumn("__spans", F.array_sort(F.concat(*parts)))
    return out.select(*(c for c in docs.columns if c != "spans"), F.col("__spans").alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; spans are sorted, overlapping ones make one stretch.

    The text is cut into blocks first, so that no stretch is looked for from the text's begin.
    """
    ends = lambda s: F.transform(s, lambda x: x["end"])

    def cut(x: Column) -> Column:
        wide = x["wide"]
        block = lambda k: F.coalesce(F.get(x["blocks"], k.cast("int")), F.lit(""))
        inside = lambda k, a, b: F.substr(block(k), (a - k * wide + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / wide), F.floor(b / wide)
            between = F.array_join(F.slice(x["blocks"], (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")
            return F.when(first == last, inside(first, a, b)).otherwise(F.concat(inside(first, a, (first + 1) * wide), between, inside(last, last * wide, b)))

        # A span leads if all spans before it end where it starts, or before. What stands before a leader begins at
        # the greatest end so far.
        leaders = _bound(x["upto"], lambda u: F.array_compact(F.zip_with(x["spans"], u, lambda s, e: F.when(s["start"] >= e, F.struct(e.alias("a"), s["start"].alias("b"))))))
        return F.concat(F.array_join(F.transform(leaders, lambda s: F.concat(part(s["a"], s["b"]), F.lit(mark))), ""), part(F.array_max(ends(x["spans"])), x["n"]))

    def blocks(t: Column) -> Column:
        n = F.length(t).cast("long")
        wide = F.greatest(F.lit(4096), 16 * F.ceil(F.sqrt(n.cast("double")))).cast("long")
        pieces = _bound(wide, lambda w: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n / w)), lambda k: F.substr(t, (k * w + 1).cast("int"), w.cast("int"))))
        return F.struct(n.alias("n"), wide.alias("wide"), pieces.alias("blocks"), spans.alias("spans"), greatest_before(ends(spans)).alias("upto"))

    return F.when(F.size(spans) == 0, text).otherwise(_bound(_bound(text, blocks), cut))


def greatest_before(numbers: Column) -> Column:
    """For each of ``numbers`` (array of long, none negative) the greatest of those before it, 0 for the first; in blocks like ``sums_before``."""
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0).cast("long"))

    def of(x: Column) -> Column:
        wide = x["wide"]
        block = lambda b: F.slice(x["all"], b * wide + 1, wide)
        tops = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x["all"]) / wide).cast("int") - 1), lambda b: most(block(b)))
        heads = _bound(tops, lambda t: F.transform(t, lambda _, b: most(F.slice(t, F.lit(1), b))))
        inside = lambda h: F.flatten(F.transform(h, lambda head, b: _bound(block(b), lambda part: F.transform(part, lambda _, k: F.greatest(head, most(F.slice(part, F.lit(1), k)))))))
        return F.when(F.size(x["all"]) == 0, F.array().cast("array<long>")).otherwise(_bound(heads, inside))

    wide = lambda a: F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
    return _bound(_bound(numbers, lambda a: F.struct(a.alias("all"), F.greatest(wide(a), F.lit(1)).alias("wide"))), of)
