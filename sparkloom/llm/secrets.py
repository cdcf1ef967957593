"""Secret scan in DataFrame operations only: base patterns, and windows of high character entropy.

Base kinds are patterns with a least length. The method adds candidate strings in which a window of fixed length, slid over
the string, reaches the entropy threshold of its character class (hex or mixed). The window's counts change by one character in
and one out, and with f(c) = c log2 c the sum of f over its counts changes by f(c + 1) - f(c) and f(c - 1) - f(c); the entropy is
log2 W - sum / W. Candidates on the allow list, or overlapping a base span, add nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base kinds: name, pattern, the group whose length counts, and the least length. The least lengths of access
#: and hex stand in the pattern: a match takes its whole run of characters, so a run too short can't hold a longer match. That of
#: assign can't, as a match that fails must still take its characters.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Candidates of the entropy scan: runs of 20 or more such characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy (bits a character) of a window, by class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Suppressed candidates: UUIDs, words (letters of one case, or capitalised) alone or joined by marks and in paths, and digits and marks.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?!.*(?:[a-z][A-Z]|[A-Z]{2}[a-z]))[A-Za-z/_=-]+$",
    r"^[0-9/_=+-]+$",
]
#: Tokens between marks that say they are no secret; the rest of their run is scanned without them.
NO_SECRET = r"(?i)(?<![a-z0-9+])[a-z0-9+]*?(?:example|sample|placeholder|xxxx|test)[a-z0-9+]*"
#: c log2 c for the counts of a window.
F_OF = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]


def found(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of struct(at, of), at in code points from 0.

    The text between matches and the matches themselves alternate, so a match begins after the lengths before it.
    """
    return F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def placed(pairs: Column) -> Column:
    """The starts of what `found` gives: a running sum of gaps and matches."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hit:string>>").alias("all"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"),
        F.when(p["hit"].isNull(), acc["all"]).otherwise(F.concat(acc["all"], F.array(F.struct((acc["at"] + p["gap"]).alias("at"), p["hit"].alias("hit"))))).alias("all"),
    )
    return F.aggregate(pairs, begin, step, lambda acc: acc["all"])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_window(s: Column) -> Column:
    """The highest entropy of a window of WINDOW characters of s (ASCII), in bits a character; 0 for shorter strings."""
    f = F.array(*(F.lit(x) for x in F_OF))
    chars = F.transform(F.split(s, "(?!^)(?!$)"), F.ascii)

    def slid(codes):
        first = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(WINDOW * math.log2(WINDOW)).alias("least"), F.lit(0).alias("i"))

        def step(acc, code):
            full = acc["i"] >= WINDOW
            out = F.when(full, F.get(codes, acc["i"] - WINDOW)).otherwise(F.lit(-1))
            n_in = F.get(acc["n"], code)
            added = acc["sum"] + F.get(f, n_in + 1) - F.get(f, n_in)
            n_out = F.get(acc["n"], F.greatest(out, F.lit(0))) + F.when(out == code, 1).otherwise(0)
            total = F.when(full, added + F.get(f, n_out - 1) - F.get(f, n_out)).otherwise(added)
            n = F.transform(acc["n"], lambda v, k: v + F.when(k == code, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            least = F.when(acc["i"] >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(n.alias("n"), total.alias("sum"), least.alias("least"), (acc["i"] + 1).alias("i"))

        return F.aggregate(codes, first, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    return let(chars, slid)


def suspicious(s: Column) -> Column:
    """Whether a candidate isn't allowed and has a window over its class's threshold that touches no token of NO_SECRET."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    bits = F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(allowed, F.lit(False)).otherwise(F.array_max(F.transform(F.split(s, NO_SECRET, -1), best_window)) >= bits)


def _base_spans(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    def long_enough(x):
        return F.length(F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]) >= least

    def span(x):
        return F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["hit"])).alias("end"), x["hit"].alias("secret"))

    return F.transform(F.filter(placed(F.col(f"_{kind}")), long_enough), span)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text): array of struct(at, rank, kind, end, secret) in order of start, then kind.

    Kinds rank in the order of KINDS, then `entropy`; spans of one start go by rank. Null and empty texts have no spans; repeated rows
    and null ids each get a row, an empty table an empty result. Other columns of docs are left out, whatever their names. Texts of
    any length are scanned whole, in memory in proportion to the longest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumns({f"_{k}": found(F.col("text"), p) for k, p, _, _ in KINDS} | {"_entropy": found(F.col("text"), CANDIDATE)}).drop("text")
    spans = [_base_spans(rank, *kind) for rank, kind in enumerate(KINDS)]
    rows = rows.select("doc_id", "_entropy", F.concat(*spans).alias("base"))
    free = F.filter(placed(F.col("_entropy")), lambda x: ~F.exists("base", lambda b: (b["at"] < x["at"] + F.length(x["hit"])) & (x["at"] < b["end"])))
    more = F.transform(
        F.filter(free, lambda x: suspicious(x["hit"])),
        lambda x: F.struct(x["at"].alias("at"), F.lit(len(KINDS)).alias("rank"), F.lit("entropy").alias("kind"), (x["at"] + F.length(x["hit"])).alias("end"), x["hit"].alias("secret")),
    )
    return rows.select("doc_id", F.array_sort(F.concat("base", more)).alias("spans"))


def op8(docs: DataFrame) -> DataFrame:
    """The digest of `scan` over all documents."""
    rows = scan(docs)
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["at"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter("spans", lambda x: x["rank"] < len(KINDS)))
    return rows.select("doc_id", *(count(k) for k, *_ in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
