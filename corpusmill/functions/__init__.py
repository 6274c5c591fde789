"""Column expressions that take and return columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that a term may be restricted to, as whole-term patterns. ``None`` keeps all.
SCRIPTS = {"cjk": "^[一-龥]+$", "letters": r"^\p{L}+$", "latin": "^[a-z]+$"}

#: Characters of texts whose words a segmenter's task holds at once, about.
PIECE = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in order, repeats included; a null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    return F.filter(parts, lambda t: t != "")


def token_counts(words: Column) -> Column:
    """array<struct<term, n>>: how often each word is in the array, by term. Sorted, equal words are neighbours; lambdas over one element bind what is used again."""
    none = F.array().cast("array<struct<term:string,n:bigint>>")

    def counted(own: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        last = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(own))
        runs = lambda at: F.transform(at, lambda i, k: F.struct(F.get(own, i).alias("term"), (last(at, k) - i).cast("long").alias("n")))
        return F.when(F.size(own) > 0, F.transform(F.array(first), runs)[0]).otherwise(none)

    return F.transform(F.array(F.sort_array(words)), counted)[0]


def segmented(text: Column, cut: Callable[[str], list[str]]) -> Column:
    """Words of a text by a segmenter of the caller's, for scripts without spaces; a null text has none.

    ``cut`` runs on the executors, on a batch of texts at a time; words of about PIECE characters are held as Python objects at once.
    """

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held, size = [], 0
            for t in texts:
                held.append([w for w in cut(t or "") if w])
                size += len(t or "")
                if size >= PIECE:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return words(text)


def longest_match(words: Iterable[str]) -> Callable[[str], list[str]]:
    """A segmenter: runs of letters, each cut from the left into the longest words of the list, else single characters in CJK runs."""
    import regex

    known = {w.lower() for w in words}
    longest = max(map(len, known), default=1)
    runs, cjk = regex.compile(r"\p{L}+"), regex.compile(SCRIPTS["cjk"])

    def cut(text: str) -> list[str]:
        out = []
        for run in runs.findall(text.lower()):
            at = 0
            if not cjk.match(run):
                out.append(run)
                continue
            while at < len(run):
                n = next((k for k in range(min(longest, len(run) - at), 1, -1) if run[at : at + k] in known), 1)
                out.append(run[at : at + n])
                at += n
        return out

    return cut


def in_script(term: Column, script: str | None) -> Column:
    return F.lit(True) if script is None else term.rlike(SCRIPTS.get(script, script))


def java_hash(text: Column, slots: int | None = None) -> Column:
    """Java's ``String.hashCode`` of an ASCII text as a signed 32-bit value, or its remainder by ``slots``."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    raw = F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    )
    signed = F.when(raw >= 2147483648, raw - 4294967296).otherwise(raw)
    return signed if slots is None else signed % slots


def idf_plain(n_docs: Column, df: Column) -> Column:
    """ln(N / (df + 1)); not positive for a term that is in nearly every document."""
    return F.log(n_docs.cast("double") / (df + 1))


def idf_single(n_docs: Column, df: Column) -> Column:
    """ln(N / (df + 1)) with a single-precision ratio, as a single-precision number."""
    return F.log((n_docs.cast("float") / (df + 1).cast("float")).cast("float").cast("double")).cast("float")


def idf_smooth(n_docs: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)); never negative."""
    return F.log((n_docs + 1).cast("double") / (df + 1))


def utf8_prefix(text: Column) -> Column:
    """The first six UTF-8 bytes as a number that keeps the binary order of texts (ties possible)."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
