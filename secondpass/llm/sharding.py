"""K-d tree sharding by weighted medians, in DataFrame operations only.

A node that is to give k shards is split along its widest dimension (spread inside
the node over spread of the whole table) where the bytes reach the share of half
the shards. The weighted median is exact: coordinates are 20 bits, followed by 40
bits of a hash of the text, and the 60-bit code is found by five histograms of 4096
bins, summed by the cluster for all nodes of a level together. Texts that are equal
share all coordinates and stay in one shard, unless a group is so heavy that whole
placement would unbalance its node by more than ``tolerance`` of a shard: then the
group itself is split by the hash of the id.

The law is ``bytes``: shards have nearly equal sizes. Null texts weigh one byte.
Rows equal in every column may be split freely; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import ranked
from secondpass.session import pin

_BITS, _STEP = 60, 12
DIMENSIONS = ("d_size", "d_lines", "d_width")


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, the coordinates (20 bits each) and the hashes that break ties."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    logarithm = lambda value: F.floor(F.log(value.cast("double")) * 32768).cast("long")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        logarithm(size).alias("d_size"), logarithm(lines).alias("d_lines"),
        F.floor((size - 1) * 200_000 / F.greatest(F.length(text), F.lit(1))).cast("long").alias("d_width"),
        F.shiftrightunsigned(F.xxhash64(text), 24).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(7)), 64 - _BITS).alias("tie"),
    )


def _by_node(node: Column, values: dict[int, Column]) -> Column:
    out = None
    for number, value in values.items():
        out = F.when(node == number, value) if out is None else out.when(node == number, value)
    return out


def _median(rows: DataFrame, code: Column, nodes: dict[int, float], below: dict[int, int]) -> tuple[dict, dict, dict]:
    """Per node the code at which the summed size passes ``nodes[node]``, the size below it and the size at it.

    ``below`` is the size already known to lie before the rows given.
    """
    prefix = {n: 0 for n in nodes}
    below = dict(below)
    at: dict[int, int] = {}
    for done in range(0, _BITS, _STEP):
        within = rows.withColumn("_code", code)
        if done:
            wanted = _by_node(F.col("_node"), {n: F.lit(p) for n, p in prefix.items()})
            within = within.where(F.shiftrightunsigned("_code", _BITS - done) == wanted)
        bins = within.groupBy(
            "_node", F.shiftrightunsigned("_code", _BITS - done - _STEP).bitwiseAND((1 << _STEP) - 1).alias("bin")
        ).agg(F.sum("size").alias("size")).collect()  # at most 4096 rows per node of a level
        table: dict[int, list[tuple[int, int]]] = {}
        for r in bins:
            table.setdefault(r["_node"], []).append((r["bin"], r["size"]))
        for node, found in table.items():
            found.sort()
            for place, (number, size) in enumerate(found):
                if below[node] + size >= nodes[node] or place == len(found) - 1:
                    prefix[node] = prefix[node] << _STEP | number
                    at[node] = size
                    break
                below[node] += size
    return prefix, below, at


def kd_partition(meta: DataFrame, shards: int = 8, target_bytes: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """``meta`` with its ``shard``; with ``target_bytes`` there are as many shards as that size asks for."""
    spread = meta.agg(F.sum("size").alias("size"), *[
        f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))
    ]).first()
    total = spread["size"] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    if not total or shards == 1:
        return meta.withColumn("shard", F.lit(0))
    whole = {d: max(1, spread[f"{d}_hi"] - spread[f"{d}_lo"]) for d in DIMENSIONS}
    node: Column = F.lit(0)
    open_nodes = {0: shards}  # first shard of a node -> shards it is to give
    while any(k > 1 for k in open_nodes.values()):
        rows = meta.withColumn("_node", node)
        stats = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("size"), *[
            (F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()}
        split = {n: k for n, k in open_nodes.items() if k > 1 and n in stats}
        if not split:
            break
        widest = {n: max(DIMENSIONS, key=lambda d: (stats[n][d] / whole[d], d)) for n in split}
        code = _by_node(F.col("_node"), {
            n: F.shiftleft(F.col(d), 40).bitwiseOR(F.col("text_hash")) for n, d in widest.items()})
        rows = rows.where(F.col("_node").isin(list(split)))
        share = {n: stats[n]["size"] * (k // 2) / k for n, k in split.items()}
        median, below, at = _median(rows, code, share, {n: 0 for n in split})
        # A code is one group of texts (or, by chance, a few): whole if that is balanced enough, else split by id.
        heavy = {n for n in split if min(share[n] - below[n], below[n] + at[n] - share[n]) > tolerance * total / shards}
        ties: dict[int, int] = {}
        if heavy:
            among = rows.withColumn("_value", code).where(
                F.col("_node").isin(list(heavy))
                & (F.col("_value") == _by_node(F.col("_node"), {n: F.lit(median[n]) for n in heavy}))
            ).drop("_value")
            ties, _, _ = _median(among, F.col("tie"), {n: share[n] for n in heavy}, {n: below[n] for n in heavy})
        right = {}
        for n in split:
            own = F.shiftleft(F.col(widest[n]), 40).bitwiseOR(F.col("text_hash"))
            if n in heavy:
                right[n] = (own > median[n]) | ((own == median[n]) & (F.col("tie") > ties[n]))
            elif share[n] - below[n] < below[n] + at[n] - share[n]:
                right[n] = own >= median[n]
            else:
                right[n] = own > median[n]
        moved = _by_node(node, {n: F.when(right[n], F.lit(n + k // 2)).otherwise(F.lit(n)) for n, k in split.items()})
        node = F.coalesce(moved, node)
        open_nodes = {m: c for n, k in open_nodes.items()
                      for m, c in ([(n, k // 2), (n + k // 2, k - k // 2)] if k > 1 else [(n, k)])}
    return meta.withColumn("shard", node.cast("int"))


def shard_documents(
    docs: DataFrame, shards: int = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    meta = pin(metadata(docs, id_col, text_col), "metadata")
    placed = kd_partition(meta, shards, target_bytes).select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
