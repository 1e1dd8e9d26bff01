"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities, then rewrite shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, ranged, reserved, stored, text_or_empty

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Transfer:
    """Bytes that leave src for dst; src == dst stays in place. Order matters: blocks leave src in this order."""

    src: int
    dst: int
    size: int


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a cheapest maximum flow, by successive shortest paths."""
    to, left, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, cap, price in edges:
        for u, v, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            out[u].append(len(to))
            to.append(v)
            left.append(c)
            cost.append(p)
    while True:
        best, via, queue, waits = [None] * n, [-1] * n, [source], {source}
        best[source] = 0
        while queue:
            u = queue.pop(0)
            waits.discard(u)
            for e in out[u]:
                if left[e] and (best[to[e]] is None or best[u] + cost[e] < best[to[e]]):
                    best[to[e]], via[to[e]] = best[u] + cost[e], e
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if best[sink] is None:
            return [left[2 * i + 1] for i in range(len(edges))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def capacities(total: int, shards: int, old: dict[int, int] | None = None, slack: float = 0.0) -> list[int]:
    """Sizes of equal shards, at most one byte apart; a shard of old within slack of that size keeps its own, so nothing of it moves."""
    near = {i: s for i, s in (old or {}).items() if 0 <= i < shards and abs(s * shards - total) <= slack * total}
    if len(near) == shards:
        near.popitem()  # one shard takes what remains
    rest, left = [i for i in range(shards) if i not in near], total - sum(near.values())
    return [near[i] if i in near else left // len(rest) + (rest.index(i) < left % len(rest)) for i in range(shards)]


def plan_transfers(old: dict[int, int], capacity: list[int]) -> list[Transfer]:
    """Block transfers that fill capacity from old shard sizes and move the fewest bytes.

    A network of one node for each old and new shard and one hub: staying costs nothing, passing the
    hub one for each byte, so it has as many edges as shards. Hub flow is cut into blocks in order.
    """
    names = sorted(old)
    if sum(old.values()) != sum(capacity):
        raise ValueError("the capacities don't add up to the old sizes")
    k, m = len(names), len(capacity)
    source, sink, hub, first_new = k + m + 1, k + m + 2, k + m, k
    edges = [(source, i, old[name], 0) for i, name in enumerate(names)]
    edges += [(first_new + j, sink, c, 0) for j, c in enumerate(capacity)]
    edges += [(i, hub, old[name], 1) for i, name in enumerate(names)] + [(hub, first_new + j, c, 0) for j, c in enumerate(capacity)]
    stays = [(i, name) for i, name in enumerate(names) if 0 <= name < m]
    edges += [(i, first_new + name, old[name], 0) for i, name in stays]
    flow = min_cost_flow(k + m + 3, edges, source, sink)
    leaves, comes, kept = flow[k + m : 2 * k + m], flow[2 * k + m : 2 * (k + m)], flow[2 * (k + m) :]
    home = {name: kept[x] for x, (_, name) in enumerate(stays)}
    out, j = [], 0
    for i, name in enumerate(names):
        if home.get(name):
            out.append(Transfer(name, name, home[name]))
        while leaves[i]:
            while not comes[j]:
                j += 1
            block = min(leaves[i], comes[j])
            out.append(Transfer(name, j, block))
            leaves[i] -= block
            comes[j] -= block
    return out


#: What places a row in its old shard; no column of these names may come with the documents.
KEY = ("_old", "_minus", "_id", "_crc")


def _order() -> list[Column]:
    return [F.col(c) for c in KEY]


def _keyed(docs: DataFrame, old_shard: Column) -> DataFrame:
    reserved(docs, *KEY)
    size = F.octet_length(text_or_empty()).cast("long") + ROW_BYTES
    return docs.withColumns({"_old": old_shard.cast("int"), "_minus": -size, "_id": F.col("doc_id"), "_crc": F.crc32(text_or_empty().cast("binary"))})


def assigned(docs: DataFrame, old_shard: Column, shards: int, slack: float = 0.0) -> tuple[DataFrame, list[Transfer]]:
    """docs with `shard`, and the transfers planned. Adds no other column.

    Within an old shard rows stand from the largest to the smallest, so that cuts fall between small
    ones; a row follows the block in which its middle byte lies. The prefix sums are distributed, and
    what comes back to the rows is the first key of each block: at most old + new shards of them, so
    the texts themselves need no join. Rows equal in id, size and checksum go to one shard.
    """
    spark = docs.sparkSession
    light = _keyed(docs, old_shard).select("_old", "_minus", "_id", "_crc")
    placed = stored(ranged(light, _order()), "shard-keys")
    parts = placed.groupBy("_old", "_pid").agg((-F.sum("_minus")).alias("_sum"))
    parts = stored(parts.withColumn("_offset", F.sum("_sum").over(Window.partitionBy("_old").orderBy("_pid")) - F.col("_sum")), "shard-parts")
    old = {r["_old"]: r["s"] for r in parts.groupBy("_old").agg(F.sum("_sum").alias("s")).collect()}
    moves = plan_transfers(old, capacities(sum(old.values()), shards, old, slack)) if old else []
    blocks, at = [], {}
    for move in moves:
        lo = at.get(move.src, 0)
        blocks.append((move.src, move.dst, lo, lo + move.size))
        at[move.src] = lo + move.size
    table = F.broadcast(spark.createDataFrame(blocks, "_old int, _dst int, _lo long, _hi long"))  # bounded by the number of shards
    within = F.sum(-F.col("_minus")).over(Window.partitionBy("_old", "_pid").orderBy("_idx")) + F.col("_offset")
    middle = placed.join(parts.select("_old", "_pid", "_offset"), ["_old", "_pid"]).withColumn("_at", within + F.floor(F.col("_minus") / 2))
    inside = (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    firsts = middle.join(table, "_old").where(inside).groupBy("_old", "_dst").agg(F.min(F.struct("_minus", "_id", "_crc")).alias("_key"))
    cuts = firsts.groupBy("_old").agg(F.sort_array(F.collect_list(F.struct(F.col("_key"), F.col("_dst")))).alias("_cuts")).collect()
    cuts = F.broadcast(spark.createDataFrame([tuple(r) for r in cuts], firsts.groupBy("_old").agg(F.sort_array(F.collect_list(F.struct(F.col("_key"), F.col("_dst")))).alias("_cuts")).schema))
    rows = _keyed(docs, old_shard).join(cuts, "_old", "left")
    key = F.struct("_minus", "_id", "_crc")
    shard = F.element_at(F.filter("_cuts", lambda c: c["_key"] <= key), -1)["_dst"]
    return rows.select(*[rows[c] for c in docs.columns if c != "shard"], shard.alias("shard")), moves


def write_shards(rows: DataFrame, path: str, only: set[int] | None = None) -> None:
    """Write rows under `<path>/shard=<n>`; only: the shards that gained or lost rows, others keep their files."""
    if only is not None:
        rows = rows.where(F.col("shard").isin(sorted(only)))
    order = [F.col("shard"), F.col("doc_id"), F.octet_length(text_or_empty())]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").mode("append").parquet(path)


def affected(moves: list[Transfer]) -> set[int]:
    return {s for m in moves if m.src != m.dst for s in (m.src, m.dst)}


def resharded(docs: DataFrame, old_shard: Column, shards: int, columns: list[Column] | None = None, slack: float = 0.0, old_path: str | None = None) -> DataFrame:
    """Reshard docs and read the new shards back: columns (those of docs), shard, slot.

    old_path: where docs lie as `<old_path>/shard=<n>`, n being old_shard. Then only the shards that
    gain or lose rows are written anew and the others are read from their files there. slack: how far
    from the mean size, as a share, a shard may stay as it is. columns are taken from the rows as
    read, before slots are joined, so texts not asked for aren't shuffled again.

    slot: the row's place in its shard, over the shard's files by name and each file's rows. Null
    text: empty, of ROW_BYTES bytes; null ids come first among equal sizes; a null old shard holds
    the rows of no shard and all of them move. Empty table: empty result.
    """
    spark = docs.sparkSession
    rows, moves = assigned(docs, F.coalesce(old_shard.cast("int"), F.lit(-1)), shards, slack)
    path, changed = new_path(spark, "shards"), affected(moves)
    write_shards(rows, path, changed if old_path else None)
    place = [F.col("shard"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    read = lambda at: spark.read.schema(rows.schema).parquet(at)
    back = read(path).select(*(columns or docs.columns), *place)
    if old_path:
        kept = sorted({m.src for m in moves} - changed)
        back = back.unionByName(read(old_path).where(F.col("shard").isin(kept)).select(*(columns or docs.columns), *place))
    files = back.groupBy("shard", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_file")) - F.col("_n")
    files = files.select(F.col("shard").alias("_s"), F.col("_file").alias("_f"), before.alias("_before"))
    out = back.join(files, (F.col("shard") == F.col("_s")) & (F.col("_file") == F.col("_f")))
    return out.select(*back.columns[: -len(place)], "shard", (F.col("_before") + F.col("_row")).cast("long").alias("slot"))
