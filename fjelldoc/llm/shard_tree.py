"""Sharding by a hierarchical weighted hash tree (operator 2).

A key descends region, rack and shard. At each level every child draws an exponential variate
-ln(u) / weight from a hash of (key, child), and the smallest draw wins. A node's weight is the sum of its
shards' weights, so a change of one weight moves keys only into or out of the subtrees whose weights
change; draws of the others stay. New capacity opens a region of its own (`layout`): keys that move go
into it and nowhere else.

Defined cases: null and empty texts are rows of size 1; a null key is hashed as the empty key; rows
with equal keys share a shard and have slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.llm.common import numbered


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int, base: int = 16, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """`base` shards in racks and regions; each further one is a region of its own."""
    out = []
    for n in range(shards):
        rack = n // per_rack
        out.append(Shard(f"g{rack // racks_per_region}", f"k{rack}", n) if n < base else Shard(f"x{n}", f"x{n}", n))
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(node)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The result of the child with the smallest draw; children with no weight take part in no draw."""
    live = {name: c for name, c in children.items() if c[0] > 0}
    if len(live) == 1:
        return next(iter(live.values()))[1]
    draws = F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, (w, _)) in enumerate(live.items())]))
    place = draws["i"]
    out = F.when(place == 0, next(iter(live.values()))[1])
    for i, (_, result) in enumerate(list(live.values())[1:], 1):
        out = out.when(place == i, result)
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard number a key descends to."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    total = lambda shards: float(sum(s.weight for s in shards))
    top = {}
    for region, racks in regions.items():
        inner = {}
        for rack, shards in racks.items():
            leaves = {f"s/{s.number}": (s.weight, F.lit(s.number)) for s in shards}
            if total(shards) > 0:
                inner[f"k/{region}/{rack}"] = (total(shards), _winner(key, leaves))
        if inner:
            top[f"g/{region}"] = (sum(w for w, _ in inner.values()), _winner(key, inner))
    if not top:
        raise ValueError("no shard has a weight above 0")
    return _winner(key, top)


def assign_shards(docs: DataFrame, key: str, tree: list[Shard], grown: list[Shard] | None = None, text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, grown_shard (null without `grown`) and slot, gapless from 0 per shard."""
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], [key, "text_crc32", "size"], "slot")
