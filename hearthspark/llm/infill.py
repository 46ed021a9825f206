"""Operator 13, fill-in-the-middle transformation over an indexable skip list.

A text's tokens (a word with the white space before it, or white space at the end) are the bottom lane of a deterministic skip list; each link of an express lane spans FAN links of
the lane below and carries two widths, in units (tokens) and in code points. A cut's rank is reached from the top lane: links are taken while the
accumulated units stay within the rank, then the search goes one lane down, so at most FAN links of each lane are read, and the accumulated code points are the place of the cut
in the text. Which texts are rearranged, how, and where the cuts lie, is a hash of seed and id, so partitions, batches and retries change nothing.

Rows are transformed where they lie, without a shuffle; a task holds a batch of texts and one skip list (about 17 bytes a token) at a time.

Cases: null and empty texts stay plain, with no tokens; texts that hold a mark stay plain, so that restore() is exact; a null id counts as an empty
string in the hash; rows of one id get the same form and the ranks that their own lengths give; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Shares in hundredths: of texts that are rearranged, and of these, of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links of a lane that one link of the next lane spans.
FAN = 16

Lane = tuple[np.ndarray, np.ndarray]


def token_widths(text: str) -> np.ndarray:
    """Code points of each token. A token ends where white space follows a word, and at the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.diff(np.concatenate([[0], ends, [len(points)]])) if len(points) else np.zeros(0, np.int64)


def lanes(widths: np.ndarray) -> list[Lane]:
    """The lanes of the skip list, bottom first: (units, code points) of each link."""
    out = [(np.ones(len(widths), np.int64), widths.astype(np.int64))]
    while len(out[-1][0]) > FAN:
        heads = np.arange(0, len(out[-1][0]), FAN)
        out.append((np.add.reduceat(out[-1][0], heads), np.add.reduceat(out[-1][1], heads)))
    return out


def descend(built: list[Lane], rank: int) -> int:
    """Code points before the token of this rank (their number: all of them)."""
    at = units = points = 0
    for lane_units, lane_points in reversed(built):
        while at < len(lane_units) and units + lane_units[at] <= rank:
            units += int(lane_units[at])
            points += int(lane_points[at])
            at += 1
        at *= FAN
    return points


def rearrange(text: str, key: str, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix, of middle, output) of a text."""
    draw = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    built = lanes(token_widths(text))
    n = len(built[0][0])
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = descend(built, first), descend(built, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that rearrange() was given. Marks begin with their only ``<``, so none can straddle a cut."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE, 1)
    one, two = head.split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: ``id``, ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain), ``output``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            found = [rearrange(t.as_py(), k.as_py(), seed, rate, suffix_first) for k, t in zip(batch.column(1), batch.column(2), strict=True)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(rearranged, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; texts are rebuilt from output and form alone."""
    restored = F.pandas_udf(_restored, "string")("output", "form")
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))
