"""Operator 1, secret scans by corpus-wide ownership frequency. DataFrame functions only.

Every whole text is scanned for candidates of three base kinds (assignments, access keys, long hex runs) and one weak kind
(long mixed tokens). Each candidate's value is hashed; the hashes are aggregated by distinct owners and repositories over
the whole corpus. A value that more than ``max_owners`` owners hold, or more than ``max_repos`` repositories of whatever owners, is a widely
copied example; the others are owner-specific and look live. Base spans are always reported; weak candidates are added (kind ``owned``) only if they
are owner-specific and touch no base span.

Cases: a null text is empty; a null id, owner or repository counts as one value of its own; repeated rows each give a row
(and one repository); an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import BLOCK, bound, cut, merged, running, spread_lookup

# The contract's kinds, in its order, and the added kind.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: [A-Z0-9]+ and [0-9a-f]+ match whole runs, so a shortest length in the pattern is the same as dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 12
#: Values held by more owners than this are examples that were copied around.
MAX_OWNERS = 2
#: So are those in more repositories than this, over all owners.
MAX_REPOS = 10

_SPAN = "struct<s:int,k:int,e:int,h:bigint>"


def _matches(text: str, pattern: str, out: str, df: DataFrame) -> DataFrame:
    """Adds ``out``: array of (s, e, m) of the leftmost non-overlapping matches, in code points, end exclusive.

    What lies between matches comes from split(), only where there are matches; starts are running sums of both lengths.
    """
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_z", F.when(F.size("_m") > 0, F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.col("_m").alias("m")), F.lit(1), F.greatest(F.size("_m"), F.lit(1)))))
    df = df.withColumn("_at", F.when(F.size("_m") > 0, running(F.col("_z"), lambda x: F.length(x["g"]) + F.length(x["m"]), lambda a, n: a + n, 0)))
    span = lambda x, at: F.struct((at + F.length(x["g"])).alias("s"), (at + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("m"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    return df.withColumn(out, F.coalesce(F.when(F.size("_m") > 0, F.zip_with("_z", "_at", span)), none)).drop("_m", "_z", "_at")


def _span(x: Column, kind: int, value: Column) -> Column:
    return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), F.xxhash64(value).alias("h"))


def candidates(docs: DataFrame, text: str = "text", out: str = "cands") -> DataFrame:
    """Adds ``out``, array of (s, k, e, h) sorted by start and kind, and drops ``text``; k indexes KINDS, h hashes the value. Weak ones may overlap others."""
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_weak", WEAK)):
        df = _matches("_t", pattern, name, df)
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    df = df.withColumn("_base", F.concat(
        F.transform(F.filter("_assign", lambda x: F.length(value(x)) >= MIN_VALUE), lambda x: _span(x, 0, value(x))),
        F.transform("_access", lambda x: _span(x, 1, x["m"])),
        F.transform("_hex", lambda x: _span(x, 2, x["m"])),
    ))
    weak = F.filter("_weak", lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    df = df.withColumn(out, F.array_sort(F.concat("_base", F.transform(weak, lambda x: _span(x, 3, x["m"])))))
    return df.drop("_t", "_assign", "_access", "_hex", "_weak", "_base", text)


def ownership(cands: DataFrame) -> DataFrame:
    """Per candidate hash ``h``: distinct owners, distinct repositories of owners, rows. Each step combines before it shuffles."""
    by_repo = cands.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def _apart(some: DataFrame) -> DataFrame:
    """Without weak candidates that overlap a base span: of those that start no later the farthest end is known, of those that start no earlier the first start."""
    base = lambda c: F.when(F.col("k") < 3, F.col(c))
    by = lambda order: Window.partitionBy("row_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached, next_ = F.max(base("e")).over(by(F.asc("s"))), F.min(base("s")).over(by(F.desc("s")))
    marked = some.withColumn("_reached", reached).withColumn("_next", next_)
    clear = (F.coalesce("_reached", F.lit(0)) <= F.col("s")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("e")))
    return marked.filter((F.col("k") < 3) | clear).drop("_reached", "_next")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: ``row_id``, ``id`` and ``spans``, array of (s, k, e, live, n_owners, n_repos) by start and kind.

    ``live``: at most ``max_owners`` owners and ``max_repos`` repositories hold the value. Weak candidates that aren't live are gone; base spans stay.
    ``row_id`` is fixed by a checkpoint and tells repeated rows apart.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("_text"))
    rows = cut(candidates(rows, "_text").withColumn("row_id", F.monotonically_increasing_id()))
    some = rows.filter(F.size("cands") > 0).select("row_id", "id", "repo", "owner", F.explode("cands").alias("c"))
    some = cut(_apart(some.select("row_id", "id", "repo", "owner", "c.s", "c.k", "c.e", "c.h")))
    freq = cut(ownership(some))
    known = spread_lookup(some, freq, "h", "n_rows", "row_id", ["n_owners", "n_repos"]).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    span = F.struct("s", "k", "e", "live", "n_owners", "n_repos")
    found = known.groupBy("row_id", "id").agg(F.array_sort(F.collect_list(F.when((F.col("k") < 3) | F.col("live"), span))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<s:int,k:int,e:int,live:boolean,n_owners:bigint,n_repos:bigint>>)")
    none = rows.filter(F.size("cands") == 0).select("row_id", "id", empty.alias("spans"))
    return found.unionByName(none)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from scan_secrets()' spans."""
    n = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        n(lambda x: x["k"] == 0).alias("n_assign"), n(lambda x: x["k"] == 1).alias("n_access"), n(lambda x: x["k"] == 2).alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        n(lambda x: x["live"]).alias("n_live"), n(lambda x: ~x["live"]).alias("n_shared"),
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each union of overlapping spans replaced by ``mask``; spans sorted by start.

    Finding a place in a string costs its length, so a text is cut into stretches of BLOCK unions first, these into pieces.
    """

    def stretch(unions: Column, b: Column) -> Column:
        first, last = b * BLOCK, F.least((b + 1) * BLOCK, F.size(unions)) - 1
        begin = F.coalesce(F.get(unions, first - 1)["e"], F.lit(0))
        piece = lambda t, x, i: F.concat(F.substr(t, F.coalesce(F.get(unions, first + i - 1)["e"], F.lit(0)) - begin + 1, x["s"] - F.coalesce(F.get(unions, first + i - 1)["e"], F.lit(0))), F.lit(mask))
        return bound(F.substr(text, begin + 1, F.get(unions, last)["e"] - begin), lambda t: F.array_join(F.transform(F.slice(unions, first + 1, F.lit(BLOCK)), lambda x, i: piece(t, x, i)), ""))

    def joined(unions: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(unions) - 1) / BLOCK).cast("int"))
        tail = F.substr(text, F.element_at(unions, -1)["e"] + 1, F.length(text))
        return F.when(F.size(unions) > 0, F.concat(F.array_join(F.transform(blocks, lambda b: stretch(unions, b)), ""), tail)).otherwise(text)

    return bound(merged(spans, False), joined)
