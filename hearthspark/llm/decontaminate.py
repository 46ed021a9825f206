"""Operator 3, benchmark decontamination by winnowing. DataFrame functions only.

Words are hashed; every run of K words gives a k-gram hash; of each W = SPAN - K + 1 consecutive k-gram hashes the least is
kept (the leftmost of equals). Any span of SPAN words shared by a text and an item holds one such window, so both keep the same k-gram
of it: the join of kept hashes meets every shared span. Each meeting carries the hashes of the words around it, is extended
word by word to both sides and counts only if SPAN words in a row agree. Items of fewer than SPAN words are one window
each: for their lengths (at most SPAN - 1 of them) all runs of that length are hashed instead.

One scan of the texts, one shuffle of hits and one row per text. Item fingerprints are broadcast only if there are at most
``broadcast_rows`` of them; else they meet the texts' fingerprints in a shuffle join.

Cases: null and empty texts have no words; items without words never occur; repeated items and ids count once (a null item id
as an empty string); repeated texts each give a row; empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import cut, lower_ascii, merged

SPAN = 13
K = 5
#: Least share of hit words in a contaminated text: 1 / SHARE.
SHARE = 20
#: Arrays of longs in Spark's rows end before 2**28 elements, so positions fit below the hash bits.
_POS_BITS = 28
BROADCAST_ROWS = 100_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and everything beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _run(h: str, at: Column, n: int, salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), *[F.get(h, at + j) for j in range(n)])


def _short_run(n: int):
    """What transform() does to each word hash: the fingerprint of the ``n`` words from there."""
    return lambda x, i: F.struct(i.alias("pos"), _run("_h", i, n, n).alias("h"), F.lit(n).alias("len"), F.lit(None).cast("array<bigint>").alias("near"))


def fingerprints(df: DataFrame, text: str, span: int, k: int, short: list[int]) -> DataFrame:
    """Replaces ``text`` by n_words and ``fps``, array of (pos, h, len, near).

    ``near`` has the word hashes from span - k words before the k-gram to as many after it, null beyond the text. Runs of the lengths
    in ``short`` come at every position, with a hash of their own kind and no ``near``.
    """
    w, r = span - k + 1, span - k
    df = df.withColumn("_h", F.transform(words(F.col(text)), lambda x: F.xxhash64(x))).drop(text).withColumn("n_words", F.size("_h"))
    # Columns that a lambda reads are read several times each, which keeps the optimizer from moving their making into the lambda.
    kept = F.shiftleft(F.lit(-1).cast("long"), _POS_BITS)
    key = lambda x, i: _run("_h", i, k).bitwiseAND(kept).bitwiseOR(i.cast("long"))
    df = df.withColumn("_k", F.transform("_h", key))
    ahead = lambda x, i: F.least(x, *[F.get("_k", i + j) for j in range(1, w)])
    # The last k - 1 entries of _k run over the end, so windows stop before they reach them.
    df = df.withColumn("_w", F.array_distinct(F.transform(F.slice("_k", F.lit(1), F.greatest(F.col("n_words") - span + 1, F.lit(0))), ahead)))
    pos = F.transform("_w", lambda m: m.bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int"))
    fps = F.transform(pos, lambda p: F.struct(p.alias("pos"), _run("_h", p, k).alias("h"), F.lit(0).alias("len"), F.array(*[F.get("_h", p + j) for j in range(-r, k + r)]).alias("near")))
    for n in short:
        whole = F.slice("_h", F.lit(1), F.greatest(F.col("n_words") - n + 1, F.lit(0)))
        fps = F.concat(fps, F.transform(whole, _short_run(n)))
    return df.withColumn("fps", fps).drop("_h", "_k", "_w")


def _extend(near: str, other: str, span: int, k: int) -> tuple[Column, Column]:
    """How many words to the left and right of the k-gram agree in a row."""
    r = span - k
    same = lambda j: F.coalesce(F.get(near, F.lit(j)) == F.get(other, F.lit(j)), F.lit(False))
    reach = lambda js: (F.array_position(F.array(*[same(j) for j in js], F.lit(False)), False) - 1).cast("int")
    return reach(range(r - 1, -1, -1)), reach(range(r + k, r + k + r))


def item_fingerprints(items: DataFrame, span: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, h, len, near) of the items; those of fewer than ``span`` words have one row, a hash of all their words."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("_text"))
    long_ = fingerprints(rows, "_text", span, k, []).select("item", F.explode_outer("fps").alias("f")).filter("f.h is not null").select("item", "f.h", "f.len", "f.near")
    few = rows.withColumn("_h", F.transform(words(F.col("_text")), lambda x: F.xxhash64(x))).withColumn("n", F.size("_h")).filter(F.col("n").between(1, span - 1))
    h = F.lit(None).cast("bigint")
    for n in range(1, span):
        h = F.when(F.col("n") == n, _run("_h", F.lit(0), n, n)).otherwise(h)
    short = few.select("item", h.alias("h"), F.col("n").alias("len"), F.lit(None).cast("array<bigint>").alias("near"))
    return long_.unionByName(short).distinct()


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, k: int = K, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per text: ``row_id``, ``id``, ``n_words``, ``spans`` (merged hit ranges of words, end exclusive), ``n_hit``, ``items`` (sorted ids).

    ``row_id`` numbers the scanned rows and tells repeated rows apart within this result.
    """
    bench = cut(item_fingerprints(items, span, k, item_id_col, item_text_col).select("item", F.col("h").alias("bh"), F.col("len").alias("blen"), F.col("near").alias("bnear")))
    n_bench = bench.count()
    short = sorted(r[0] for r in bench.filter("blen > 0").select("blen").distinct().collect())  # at most span - 1 numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).withColumn("row_id", F.monotonically_increasing_id())
    rows = fingerprints(rows, "_text", span, k, short)
    mark = F.expr("array(named_struct('pos', -1, 'h', cast(null as bigint), 'len', 0, 'near', cast(null as array<bigint>)))")  # keeps each text, hit or not
    # explode_outer: for explode(), the optimizer would add a filter on the size of the array and compute the whole array for it.
    rows = rows.select("row_id", "id", "n_words", F.explode_outer(F.concat(mark, "fps")).alias("f")).select("row_id", "id", "n_words", "f.*")
    small = n_bench <= broadcast_rows
    key = F.col("h") if small else F.coalesce("h", F.xxhash64("row_id"))  # marks are dealt out evenly
    met = rows.join(F.broadcast(bench) if small else bench, (key == F.col("bh")) & F.col("h").isNotNull() & (F.col("len") == F.col("blen")), "left")
    met = met.filter(F.col("h").isNull() | F.col("bh").isNotNull())
    left, right = _extend("near", "bnear", span, k)
    met = met.withColumn("_l", left).withColumn("_r", right)
    size = F.when(F.col("len") > 0, F.col("len")).otherwise(F.col("_l") + k + F.col("_r"))
    start = F.when(F.col("len") > 0, F.col("pos")).otherwise(F.col("pos") - F.col("_l"))
    real = F.col("bh").isNotNull() & ((F.col("len") > 0) | (F.col("_l") + k + F.col("_r") >= span))
    met = met.select("row_id", "id", "n_words", F.when(real, F.struct(start.alias("s"), (start + size).alias("e"))).alias("span"), F.when(real, F.col("item")).alias("item"))
    out = met.groupBy("row_id", "id").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    out = out.withColumn("spans", merged(F.col("spans"), True))
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]).cast("long")))


def contaminated(share: int = SHARE) -> Column:
    """At least 1 / share of the words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
