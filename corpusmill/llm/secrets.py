"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that every match
must contain. Documents are indexed by the trigrams that any rule asks for; the postings,
kept by blocks of documents, are intersected and united as the queries say, and only the
documents left are verified with the expression itself. A rule without a mandatory trigram
scans every document. Only DataFrame functions; the queries are derived on the driver from
the rules alone.
"""

from __future__ import annotations

import re._constants as K
import re._parser as P
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of, with_text
from corpusmill.session import materialise


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern, leftmost and not overlapping; of those, the ones whose group has min_length characters."""

    kind: str
    pattern: str
    min_length: int = 1
    group: int = 0
    fold: bool = False  # letters in either case

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


#: The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]+", 16),
)
#: Public formats of further credentials.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("live", "[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

#: Documents (distinct texts) a block of postings, about; candidates that a broadcast may carry.
BLOCK, BROADCAST_ROWS = 20_000, 200_000
#: Alternatives that an exact set may have before it is turned into trigrams.
EXACT = 24

Query = tuple  # ("all",) | ("gram", g) | ("and", q, ...) | ("or", q, ...)
ALL: Query = ("all",)


def _both(kind: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for q in parts:
        flat += q[1:] if q[0] == kind else [q]
    if kind == "or" and (ALL in flat or not flat):
        return ALL
    flat = sorted({q for q in flat if q != ALL}, key=repr)
    return ALL if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _grams(strings: set[str]) -> Query:
    """One of the strings is in the text."""
    return _both("or", [_both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings it can match or None, query of what must be there)."""
    exact: set[str] | None = {""}
    needs: list[Query] = []
    whole = True

    def flush() -> None:
        nonlocal exact, whole
        needs.append(_grams(exact))
        exact, whole = {""}, False

    for op, arg in tree:
        if op is K.LITERAL:
            own, need = {chr(arg)}, ALL
        elif op is K.IN:
            chars: set[str] | None = set()
            for kind, a in arg:
                span = {a} if kind is K.LITERAL else set(range(a[0], a[1] + 1)) if kind is K.RANGE and a[1] - a[0] < EXACT else None
                chars = None if chars is None or span is None else chars | {chr(c) for c in span}
            own, need = (chars if chars and len(chars) <= 8 else None), ALL
        elif op is K.SUBPATTERN:
            own, need = _walk(arg[3])
        elif op is K.BRANCH:
            walked = [_walk(t) for t in arg[1]]
            sets = [w[0] for w in walked]
            own = None if any(s is None for s in sets) else set().union(*sets)
            need = _both("or", [w[1] if w[0] is None else _both("and", [w[1], _grams(w[0])]) for w in walked])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            lo, hi, body = arg
            inner, inside = _walk(body)
            if inner is not None and hi == 1:
                own, need = (inner | {""} if lo == 0 else inner), ALL
            elif inner is not None and lo == hi and len(inner) == 1:
                own, need = {next(iter(inner)) * int(lo)}, ALL
            else:
                own, need = None, (inside if lo else ALL)
        elif op is K.AT:
            own, need = {""}, ALL
        else:
            own, need = None, ALL
        needs.append(need)
        if own is None:
            flush()
        else:
            joined = {a + b for a in exact for b in own}
            if len(joined) > EXACT:
                flush()
                joined = own
            exact = joined
    return (exact, _both("and", needs)) if whole else (None, _both("and", [*needs, _grams(exact)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, in lower case, that every text with a match satisfies; ALL if none is mandatory."""
    exact, need = _walk(P.parse(pattern))
    query = need if exact is None else _both("and", [need, _grams(exact)])
    return _folded(query)


def _folded(q: Query) -> Query:
    return ("gram", q[1].lower()) if q[0] == "gram" else q if q == ALL else _both(q[0], [_folded(x) for x in q[1:]])


def _all_grams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "gram" else set().union(*[_all_grams(x) for x in q[1:]]) if q != ALL else set()


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings: block, gram (place in the list), ids (digests of texts, sorted). Copies of a text are one entry."""
    low = docs.select(F.xxhash64(text_of()).alias("id"), F.lower(text_of()).alias("low"))  # lower-cased once for all
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    rows = low.select("id", found.alias("grams")).select("id", F.explode("grams").alias("gram")).distinct()
    blocks = F.lit(max(1, -(-docs.count() // BLOCK)))
    return rows.groupBy(F.pmod("id", blocks).alias("block"), "gram").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def candidates(postings: DataFrame, queries: dict[str, Query], grams: list[str]) -> DataFrame:
    """id, rules: the kinds whose query a text's trigrams satisfy."""
    place = {g: i for i, g in enumerate(grams)}
    block = postings.groupBy("block").pivot("gram", list(range(len(grams)))).agg(F.first("ids"))
    none = F.array().cast("array<bigint>")

    def eval_(q: Query) -> Column:
        if q[0] == "gram":
            return F.coalesce(F.col(f"`{place[q[1]]}`"), none)
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, [eval_(x) for x in q[1:]])

    def hits_of(kind: str, q: Query) -> Column:
        return F.transform(eval_(q), lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))

    hits = [hits_of(k, q) for k, q in queries.items()]
    rows = block.select(F.explode(F.concat(*hits)).alias("h"))
    return rows.groupBy("h.id").agg(F.collect_set("h.kind").alias("rules"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, stop>> of a rule's matches; places count code points, stop is exclusive.

    Matches and the texts between them come from the same engine, so a match starts after
    the lengths of all before it.
    """
    m = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    g = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else m
    gaps = F.slice(F.split(text, rule.java, -1), F.lit(1), F.size(m))
    each = F.arrays_zip(m.alias("m"), g.alias("g"), gaps.alias("gap"))
    kind = "struct<pos:int,out:array<struct<start:int,ord:int,stop:int>>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,ord:int,stop:int>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop")))
        return F.struct(stop.alias("pos"), F.when(F.length(x["g"]) >= rule.min_length, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.aggregate(each, zero, step)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``__spans`` to docs (doc_id, text, ...): array<struct<start, ord, stop>> by start, then rule.

    A null or empty text has none; repeated rows have theirs each; an empty table stays empty.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALL}
    grams = sorted(set().union(*[_all_grams(q) for q in indexed.values()]))
    text = text_of()
    rows = docs.withColumn("__id", F.xxhash64(text))
    if indexed:
        found = materialise(candidates(index(docs, grams), indexed, grams).select(F.col("id").alias("__id"), F.col("rules").alias("__rules")), "candidates")
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "__id", "left")
    else:
        rows = rows.withColumn("__rules", F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,ord:int,stop:int>>")
    each = []
    for i, r in enumerate(rules):
        # The least length is asked for first: a cheap look before places are worked out.
        wanted = F.coalesce(F.array_contains("__rules", r.kind), F.lit(False)) if r.kind in indexed else text.rlike(_at_least(r))
        each.append(F.when(wanted, spans(text, r, i)).otherwise(empty))
    return rows.withColumn("__spans", F.array_sort(F.concat(*each))).drop("__id", "__rules")


def _at_least(rule: Rule) -> str:
    """For a repeated class alone, the class repeated as often as the least length says; else the rule's own pattern."""
    one_class = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1
    return f"{rule.pattern[:-1]}{{{rule.min_length}}}" if one_class else rule.java


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(i: int):
    return lambda o: o == i


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans of every document."""
    rows = scan(docs.select("doc_id", "text"), rules)
    base = F.filter("__spans", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.filter(F.col("__spans")["ord"], _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(listed(base, rules).cast("binary"), 256).alias("base_sha256"), listed(F.col("__spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same documents with every found span replaced by the mark; overlapping spans are one. n_chars follows.

    A null text stays null, repeated rows stay, and columns of any name pass through.
    """
    rows = scan(docs.select(F.struct("*").alias("row"), "text"), rules)
    text = text_of()
    kind = "struct<pos:int,out:string>"

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        out = F.when(apart, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), out.alias("out")).cast(kind)

    cut = F.aggregate("__spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")).cast(kind), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    out = rows.select("row", F.when(F.size("__spans") > 0, cut).otherwise(F.col("text")).alias("text"))
    return with_text(out, docs.columns)
