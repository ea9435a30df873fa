"""Sharding by sampled splitters.

Every record has a key, a hash of its text, so that equal texts are one key. A
size-weighted sample of the keys gives splitters of many small ranges; ranges that turn
out overfull are sampled again and subdivided, down to single keys. Consecutive ranges
then make up shards of near equal size.

A group of equal texts that is large beside a shard goes whole into the shard with most
room, before the ranges fill what is left. Where it fits into none, near equal sizes come
first: its records are keyed by a hash of their id too and are subdivided in the same
way, and where very many records even share both, they are numbered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import fresh, materialise

SHARDS = 8
#: Ranges aimed at for each shard, or more where one would have over so many bytes, but no more than in all;
#: a range of over twice its share of all bytes is overfull.
RANGES, RANGE_BYTES, MOST_RANGES = 128, 256 << 20, 1 << 19
#: Keys sampled for each range aimed at; about SAMPLE times the ranges reach the driver in a round.
SAMPLE = 16
#: Overfull ranges that are subdivided in one round.
ROUND = 1024


def _looked_up(key: Column, splitters: np.ndarray) -> Column:
    """The number of splitters up to the key."""

    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right").astype(np.int64))

    return F.pandas_udf(run, "long")(key)


def _sampled(keys: DataFrame, every: float) -> np.ndarray:
    """About one key for each ``every`` bytes: the chance of a key grows with its size. A hash decides, so reruns agree."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(every)))
    drawn = (F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)) < chance
    return np.array([r[0] for r in keys.where(drawn).select("key").distinct().collect()], dtype=np.int64)


def _quantiles(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` splitters from the sample."""
    sample = np.sort(sample)
    return np.unique(sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]) if len(sample) else sample


def splitters_of(keys: DataFrame, aim: float, fixed: np.ndarray | None = None) -> tuple[np.ndarray, pd.DataFrame]:
    """Splitters of the ``keys (key, size)``, and a row for each range between them: ``rows, size, low, high``.

    No range has over twice ``aim`` bytes, unless it holds a single key. ``fixed``
    splitters are among those returned.
    """
    every = max(1.0, aim / SAMPLE)
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = _quantiles(_sampled(keys, every), int(-(-total // max(1.0, aim))))
    splitters = splitters if fixed is None else np.unique(np.concatenate([splitters, fixed]))
    while True:
        dealt = keys.withColumn("range", _looked_up(F.col("key"), splitters))
        found = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = [r for r in found if r["size"] > 2 * aim and r["low"] < r["high"]][:ROUND]
        if not over:
            table = pd.DataFrame({"rows": 0, "size": 0, "low": 0, "high": -1}, index=range(len(splitters) + 1), dtype=np.int64)
            for r in found:
                table.loc[r["range"]] = (r["rows"], r["size"], r["low"], r["high"])
            return splitters, table
        inside = dealt.where(F.col("range").isin([r["range"] for r in over])).select("key", "size")
        ends = np.array([x for r in over for x in (r["low"] + 1, r["high"])], dtype=np.int64)
        splitters = np.unique(np.concatenate([splitters, _sampled(inside, every), ends]))


def packed(size: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each range, and -1 for heavy ones that fit into none.

    Heavy ranges come first, the largest into the shard with most room. What is left of
    each shard's share then gives the places at which the others are cut, in order.
    """
    share, load = size.sum() / shards, np.zeros(shards)
    place = np.full(len(size), -1, dtype=np.int64)
    for k in sorted(np.flatnonzero(heavy).tolist(), key=lambda k: (-size[k], k)):
        s = int(load.argmin())
        if load[s] + size[k] <= share:
            place[k] = s
            load[s] += size[k]
    light = np.flatnonzero(~heavy)
    room = np.cumsum(share - load)
    middle = (np.cumsum(size[light]) - size[light] / 2) * (room[-1] / max(1, size[light].sum()))
    place[light] = np.minimum(shards - 1, np.searchsorted(room, middle, side="right"))
    return place


def _plan(keys: DataFrame, shards: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, bool]:
    """``(ranges, splitters, split, inner, divided)`` for ``keys (key, row_key, size)``.

    ``ranges`` has ``rows, size, place, start`` of each range, first those between the
    ``splitters`` of keys, then those between the ``inner`` splitters of the ``split``
    keys' records. Not ``divided``: many records share even that.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = max(shards * RANGES, min(MOST_RANGES, int(total // RANGE_BYTES)))
    aim, large = total / n, total / (shards * RANGES)
    splitters, ranges = splitters_of(keys.select("key", "size"), aim)
    size, heavy = ranges["size"].to_numpy(), ((ranges["size"] > 2 * large) & (ranges["low"] == ranges["high"])).to_numpy()
    place = packed(size, heavy, shards)
    split = np.sort(ranges["low"].to_numpy()[place < 0])
    inner, divided = np.empty(0, dtype=np.int64), True
    if len(split):
        pieces = keys.withColumn("key", _inner_key(F.col("key"), F.col("row_key"), split)).where("key >= 0").select("key", "size")
        inner, more = splitters_of(pieces, large, np.arange(1, len(split), dtype=np.int64) << _shift(split))
        divided = not ((more["size"] > 2 * large) & (more["rows"] > 1) & (more["low"] == more["high"])).any()
        ranges.loc[place < 0, ["rows", "size"]] = 0
        ranges = pd.concat([ranges, more], ignore_index=True)
        heavy = np.concatenate([heavy & (place >= 0), np.zeros(len(more), dtype=bool)])
        place = packed(ranges["size"].to_numpy(), heavy, shards)
    ranges["place"] = place
    rows = ranges["rows"].to_numpy()
    start = np.zeros(len(rows), dtype=np.int64)
    for s in range(shards):
        here = place == s
        start[here] = np.cumsum(rows[here]) - rows[here]
    ranges["start"] = start
    return ranges, splitters, split, inner, divided


def _shift(split: np.ndarray) -> int:
    return 62 - int(len(split)).bit_length()


def _inner_key(key: Column, row_key: Column, split: np.ndarray) -> Column:
    """The key of a record of a ``split`` key: that key's number, then bits of the record's own key; -1 for others."""
    shift = _shift(split)

    def run(keys: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(_inner(keys.to_numpy(), rows.to_numpy(), split, shift))

    return F.pandas_udf(run, "long")(key, row_key)


def _inner(keys: np.ndarray, rows: np.ndarray, split: np.ndarray, shift: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(split, keys), len(split) - 1)
    own = (rows.astype(np.int64).view(np.uint64) >> np.uint64(64 - shift)).astype(np.int64)
    return np.where(split[at] == keys, (at << shift) | own, -1)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; existing columns of those names are replaced.

    A row's size is its text's UTF-8 bytes plus 1; the bytes of the shards are nearly
    equal. Equal texts stay in one shard, unless they are more than any shard has room
    for. Slots are gapless in each shard, from 0, in the order of the ranges. A null text
    has no bytes and the CRC of an empty one, and falls into the group of empty texts; a
    null id is hashed as such. Rows may repeat; other columns may have any name. An empty
    table gives an empty result. The numbers of shards and ranges bound what the driver
    holds; a range bounds what one task orders.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    number = fresh(docs, "number")
    out = _sharded(docs, shards, id_col, text_col, None)
    if out is None:
        numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        out = _sharded(numbered, shards, id_col, text_col, number).drop(number)
    return out


def _sharded(docs: DataFrame, shards: int, id_col: str, text_col: str, number: str | None) -> DataFrame | None:
    """The sharded rows; None where many records share their text and id and are to be numbered first."""
    key, row_key, cut, start = (fresh(docs, x) for x in ("key", "row_key", "range", "start"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = {
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text),
        key: F.shiftleft(F.crc32(text), 31).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))),
        row_key: F.xxhash64(id_col, number) if number else F.xxhash64(id_col),
    }
    sized = docs.withColumns(own)
    keys = materialise(sized.select(F.col(key).alias("key"), F.col(row_key).alias("row_key"), "size"), "keys")
    ranges, splitters, split, inner, divided = _plan(keys, shards)
    if not divided and number is None:
        return None
    place, starts, shift = ranges["place"].to_numpy().astype(np.int64), ranges["start"].to_numpy(), _shift(split)

    def run(keys: pd.Series, rows: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(splitters, keys.to_numpy(), side="right")
        if len(split):
            own = _inner(keys.to_numpy(), rows.to_numpy(), split, shift)
            at = np.where(own >= 0, len(splitters) + 1 + np.searchsorted(inner, own, side="right"), at)
        return pd.DataFrame({"range": at, "shard": place[at], "start": starts[at]})

    found = F.pandas_udf(run, "range long, shard int, start long")(F.col(key), F.col(row_key))
    dealt = sized.withColumn(cut, found)
    order = Window.partitionBy(f"{cut}.range").orderBy(key, row_key, id_col, *([number] if number else []))
    slot = (F.row_number().over(order) - 1 + F.col(f"{cut}.start")).cast("long")
    return dealt.withColumns({"shard": F.col(f"{cut}.shard"), "slot": slot}).drop(key, row_key, cut)
