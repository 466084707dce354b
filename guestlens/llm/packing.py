"""Filling containers of permitted capacities by variable-capacity best fit.

A container of capacity c costs c + c * c / COST_LENGTH: room, and the work over a sequence that grows with its square. Items
are spread over groups of bounded size by a hash, and each group is packed on its own: best fit in order of falling size;
where nothing fits, the capacity is opened that costs least per token it may expect; at the end every container is downsized
to the smallest permitted capacity that holds its contents. How much of a container stays unused isn't known before, so the
group is packed with each capacity as the one to prefer and by the expected cost, and the arrangement of the least total cost
counts. A group of GROUP_ITEMS items leaves a handful of containers partly empty, which is all that packing in groups costs.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 20_000
COST_LENGTH = 262_144  # capacity at which the work over a sequence costs as much as its room


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / COST_LENGTH


Packing = tuple[list[tuple[int, int, int, int]], list[int]]


def pack(sizes: list[int], capacities: list[int]) -> Packing:
    """The cheapest arrangement found: (item, first token, tokens, container) for each piece, and the containers' capacities.

    Only an item larger than the largest capacity is split, into full pieces and a rest. Empty items have no place.
    """
    caps = sorted(set(capacities))
    tries = [arranged(sizes, caps, p) for p in ([None, *caps] if len(caps) > 1 else [None])]
    return min(tries, key=lambda t: sum(map(cost, t[1])))


def arranged(sizes: list[int], caps: list[int], preferred: int | None) -> Packing:
    """Best fit that opens the preferred capacity where it holds the item, else the least that does; by expected cost without one."""
    largest = caps[-1]
    pieces = []
    for i, n in enumerate(sizes):
        at = 0
        while n - at > 0:
            take = min(largest, n - at)
            pieces.append((take, i, at))
            at += take
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    left = sum(p[0] for p in pieces)
    smallest = pieces[-1][0] if pieces else 0
    room: list[int] = []  # distinct free sizes, rising
    bins_with: dict[int, list[int]] = {}
    free, used, out = [], [], []
    opened = []

    def put(b: int) -> None:
        r = free[b]
        if r >= smallest > 0:
            if r not in bins_with:
                bisect.insort(room, r)
                bins_with[r] = []
            bins_with[r].append(b)

    for size, item, at in pieces:
        k = bisect.bisect_left(room, size)
        if k < len(room):
            r = room[k]
            b = bins_with[r].pop()
            if not bins_with[r]:
                del bins_with[r]
                room.pop(k)
        else:
            # contents a capacity may expect: at most what remains, and half a smallest item stays free
            fits = [c for c in caps if c >= max(size, preferred or 0)] or [c for c in caps if c >= size]
            c = fits[0] if preferred else min(fits, key=lambda c: (cost(c) / max(size, min(left, c - min(c - size, smallest / 2))), c))
            b = len(free)
            free.append(c)
            used.append(0)
            opened.append(c)
        free[b] -= size
        used[b] += size
        left -= size
        out.append((item, at, size, b))
        put(b)
    return out, [next(c for c in caps if c >= u) for u in used]


def packed(items: DataFrame, plans: dict[str, list[int]], key: str = "doc_id", size: str = "n_tokens", groups: int = 1) -> DataFrame:
    """One row per piece and plan: plan, container, capacity, key, first_token, n_tokens.

    NULL and zero sizes take no place; repeated keys are separate items.
    """
    kind = dict(items.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], ascending=[False, True])
        keys, sizes, group = pdf[key].tolist(), [int(n) for n in pdf[size]], int(pdf["g"].iloc[0])
        rows = []
        for plan, capacities in plans.items():
            out, caps = pack(sizes, capacities)
            rows += [(plan, f"{plan}-{group}-{b}", caps[b], keys[i], at, n) for i, at, n, b in out]
        return pd.DataFrame(rows, columns=["plan", "container", "capacity", key, "first_token", "n_tokens"])

    grouped = items.where(F.col(size) > 0).select(key, size, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g")).repartition(groups, "g")
    return grouped.groupBy("g").applyInPandas(run, f"plan string, container string, capacity int, `{key}` {kind}, first_token bigint, n_tokens bigint")
