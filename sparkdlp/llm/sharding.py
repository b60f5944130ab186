"""Balanced label propagation: linked documents drift into one shard while the shards' bytes stay near equal.

Documents with equal texts are linked. Every document starts in a shard by hash. In each round a group looks
where most of its bytes are and its other members ask to move there; a shard accepts moves in a fixed order up to
its capacity quota. Between rounds, documents without links move from shards that hold too much to shards that
hold too little, so there is room again and the sizes end up near equal. A group that would fill much of a shard
is cut into parts first, each of which counts as a group.

Groups that the rounds leave in several shards are then brought together. What documents without links cannot even
out is evened out by groups that move as a whole; only what no whole group can even out takes single rows, of one
cell of groups per shard where that suffices.

Only sums per shard and cell travel to the driver or into a broadcast (SHARDS * CELLS rows at most); moves are
decided for whole cells of documents, so no shard's documents are ever ordered in one place.

Law: ``bytes``. Defined cases: a null text counts as the empty text and has size 1. Rows that repeat an id are
placed by their texts; repeated rows each get a slot of their own. An empty table gives an empty result. Other
columns than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.llm.common import saved, small

SHARDS = 16
CELLS = 4096
#: What a shard may hold over the mean while groups move, and what is left between shards at the end.
SLACK = 0.30
TOLERANCE = 0.001
ROUNDS = 5
BALANCE_ROUNDS = 8
#: A part of a group fills at most this share of a shard.
PART = 0.25
SLOT_ROWS = 50_000


def linked(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, seed (of the row), unit (its group's part; null without links)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g")
    )
    rows = saved(rows)
    groups = rows.groupBy("g", "text_crc32", "size").agg(F.count("*").alias("n")).where("n > 1")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("size") / F.lit(max(1.0, PART * total / shards))))
    joined = rows.join(groups.withColumn("parts", parts), ["g", "text_crc32", "size"], "left")
    seed = F.xxhash64("doc_id", "g", F.lit(10))
    unit = F.when(F.col("parts").isNotNull(), F.xxhash64("g", "text_crc32", "size", F.pmod(seed, F.col("parts"))))
    return joined.select("doc_id", "size", "text_crc32", seed.alias("seed"), unit.alias("unit"))


def loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def lookup(column: str, values: list) -> Column:
    """values[column] for a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(column) + 1)


def even(now: list[int]) -> bool:
    """Whether no shard is further from the mean than the tolerance."""
    mean = sum(now) // len(now)
    return max(now) <= mean or max(abs(n - mean) for n in now) <= TOLERANCE * mean


def unit_cell() -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(CELLS)).cast("int")


def propagate(state: DataFrame, shards: int) -> DataFrame:
    """One round: members of groups move to the shard with most of their group's bytes, as far as quotas allow."""
    now = loads(state, shards)
    room = [max(0, int((1 + SLACK) * sum(now) / shards) - n) for n in now]
    own = state.where(F.col("unit").isNotNull()).groupBy("unit", "shard").agg(F.sum("size").alias("bytes"))
    best = F.max_by("shard", F.struct("bytes", F.xxhash64("unit", "shard")))
    # Groups that are together already have nothing to ask for.
    wish = own.groupBy("unit").agg(best.alias("target"), F.count("*").alias("places")).where("places > 1").select("unit", "target")
    # Only members of such groups take part in the join; documents without links have no key to meet on.
    linked_rows, others = state.where(F.col("unit").isNotNull()), state.where(F.col("unit").isNull())
    asked = linked_rows.join(wish, "unit", "left").withColumn("cell", unit_cell())
    moving = F.col("target").isNotNull() & (F.col("target") != F.col("shard"))
    cells = asked.where(moving).groupBy("target", "cell").agg(F.sum("size").alias("bytes")).where(F.col("bytes") <= lookup("target", room))
    upto = F.sum("bytes").over(Window.partitionBy("target").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    taken = cells.withColumn("upto", upto).where(F.col("upto") <= lookup("target", room)).select("target", "cell", F.lit(True).alias("taken"))
    moved = asked.join(F.broadcast(taken), ["target", "cell"], "left")  # at most SHARDS * CELLS rows
    moved = moved.select("doc_id", "size", "text_crc32", "seed", "unit", F.when(F.col("taken"), F.col("target")).otherwise(F.col("shard")).cast("int").alias("shard"))
    return saved(moved.unionByName(others))


def balance(state: DataFrame, shards: int, turn: int, cut: Iterable[tuple[int, int]] = ()) -> tuple[DataFrame, bool]:
    """Moves documents from shards above the mean to shards below; False when nothing is left to move.

    Documents without links move, and single rows of the groups in the (shard, cell) of ``cut``.
    """
    now = loads(state, shards)
    mean = sum(now) // shards
    over, under = [max(0, n - mean) for n in now], [max(0, mean - n) for n in now]
    if even(now):
        return state, False
    torn = F.col("shard") * CELLS + unit_cell()
    may = F.col("unit").isNull() | F.coalesce(torn.isin([shard * CELLS + cell for shard, cell in cut]), F.lit(False))
    fits = (F.col("size") <= lookup("shard", over)) & may
    ready = state.withColumn("cell", F.when(fits, F.pmod(F.xxhash64("seed", F.lit(turn)), F.lit(CELLS))))
    cells = ready.where(F.col("cell").isNotNull()).groupBy("shard", "cell").agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    leaving = cells.withColumn("upto", upto).where(F.col("upto") <= lookup("shard", over))
    # The leaving bytes of all shards in a row are dealt to the gaps in a row.
    ahead = [sum(over[:i]) for i in range(shards)]
    place = F.col("upto") - F.col("bytes") + lookup("shard", ahead)
    target, reach = F.lit(None).cast("int"), 0
    for i in reversed([i for i in range(shards) if under[i]]):
        reach = sum(under[:i])
        target = F.when(place >= reach + under[i], target).otherwise(F.lit(i))
    moves = leaving.select("shard", "cell", target.alias("target")).where(F.col("target").isNotNull())
    moved = ready.join(F.broadcast(moves), ["shard", "cell"], "left")  # at most SHARDS * CELLS rows
    return saved(moved.select("doc_id", "size", "text_crc32", "seed", "unit", F.coalesce("target", "shard").cast("int").alias("shard"))), True


def moved_cells(state: DataFrame, moves: list[tuple[int, int, int]]) -> DataFrame:
    """All rows of groups in the (shard, cell) of ``moves`` go to its target."""
    told = state.sparkSession.createDataFrame(moves, "shard int, cell int, target int")
    moved = state.withColumn("cell", F.when(F.col("unit").isNotNull(), unit_cell())).join(F.broadcast(told), ["shard", "cell"], "left")  # at most SHARDS * CELLS rows
    return saved(moved.select("doc_id", "size", "text_crc32", "seed", "unit", F.coalesce("target", "shard").cast("int").alias("shard")))


def gather(state: DataFrame, shards: int) -> DataFrame:
    """Brings the groups together that are still in several shards; a cell of them goes where it fits."""
    own = state.where(F.col("unit").isNotNull())
    apart = own.groupBy("unit").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).where("low != high")
    apart = saved(apart.select("unit", unit_cell().alias("cell")))
    if not apart.limit(1).count():
        return state
    asked = state.join(small(apart, 16), "unit", "left")
    sums: dict[int, dict[int, int]] = {}
    for r in asked.where(F.col("cell").isNotNull()).groupBy("cell", "shard").agg(F.sum("size").alias("n")).collect():
        sums.setdefault(r["cell"], {})[r["shard"]] = r["n"]
    now = loads(state, shards)
    mean, targets = sum(now) / shards, []
    for parts in sums.values():
        for shard, n in parts.items():
            now[shard] -= n
    for cell, parts in sorted(sums.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(parts.values())
        most = max(parts, key=lambda shard: (parts[shard], shard))
        target = most if now[most] + n <= mean else now.index(min(now))
        now[target] += n
        targets.append((cell, target))
    told = state.sparkSession.createDataFrame(targets, "cell int, target int")
    moved = asked.join(F.broadcast(told), "cell", "left")  # at most CELLS rows
    return saved(moved.select("doc_id", "size", "text_crc32", "seed", "unit", F.coalesce("target", "shard").cast("int").alias("shard")))


def shift(state: DataFrame, shards: int) -> tuple[DataFrame, bool]:
    """Whole groups, by cells, move from the fullest shards to the emptiest; False when no move brings them nearer."""
    now = loads(state, shards)
    if even(now):
        return state, False
    cells = [[] for _ in now]
    for r in state.where(F.col("unit").isNotNull()).groupBy("shard", unit_cell().alias("cell")).agg(F.sum("size").alias("n")).collect():
        cells[r["shard"]].append((r["n"], r["cell"]))
    for own in cells:
        own.sort()
    moves, mean, spent = [], sum(now) // shards, set()
    while not even(now):
        above = [i for i, n in enumerate(now) if n > mean and i not in spent]
        if not above:
            break
        top, low = max(above, key=now.__getitem__), now.index(min(now))
        own, gap = cells[top], now[top] - now[low]
        # The cell that leaves the two shards nearest to each other.
        near = bisect_right(own, (gap // 2, CELLS)) - 1
        if near < 0:
            near = 0 if own and own[0][0] < gap else None
        if near is None:
            spent.add(top)
            continue
        n, cell = own.pop(near)
        now[top], now[low] = now[top] - n, now[low] + n
        moves.append((top, cell, low))
    return (moved_cells(state, moves), True) if moves else (state, False)


def to_cut(state: DataFrame, shards: int, cut: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """The cells of groups that give single rows: per shard above the mean those cut before, then the smallest that suffices."""
    now = loads(state, shards)
    mean, out = sum(now) // shards, set()
    over = [max(0, n - mean) for n in now]
    fit = state.where(F.col("unit").isNotNull() & (F.col("size") <= lookup("shard", over)))
    cells = [[] for _ in now]
    for r in fit.groupBy("shard", unit_cell().alias("cell")).agg(F.sum("size").alias("n")).collect():
        cells[r["shard"]].append((r["n"], r["cell"]))
    for shard, own in enumerate(cells):
        left = over[shard]
        for n, cell in own:
            if (shard, cell) in cut and left > 0:
                out.add((shard, cell))
                left -= n
        own = sorted(x for x in own if (shard, x[1]) not in cut)
        while left > 0 and own:
            n, cell = own.pop(min(bisect_left(own, (left, -1)), len(own) - 1))
            out.add((shard, cell))
            left -= n
    return out


def slots(state: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps: buckets are counted, then numbered by themselves."""
    rows = state.count()
    buckets = max(1, -(-rows // SLOT_ROWS))
    placed = state.withColumn("bucket", F.pmod(F.xxhash64("seed", F.lit(77)), F.lit(buckets)))
    counted = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(counted.select("shard", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    numbered = placed.withColumn("own", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "seed", "text_crc32")))
    joined = numbered.join(small(offsets, 32), ["shard", "bucket"])
    return joined.withColumn("slot", (F.col("ahead") + F.col("own") - 1).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) for every document."""
    state = linked(docs, shards, doc_id, text).withColumn("shard", F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(shards)).cast("int"))
    state, turn, more = saved(state), 0, True
    for _ in range(ROUNDS):
        state, _ = balance(propagate(state, shards), shards, turn)
        turn += 1
    state = gather(state, shards)
    for _ in range(BALANCE_ROUNDS // 2):  # documents without links first, then whole groups for what is left
        for _ in range(BALANCE_ROUNDS // 2):
            state, more = balance(state, shards, turn)
            turn += 1
            if not more:
                break
        state, more = shift(state, shards)
        if not more:
            break
    cut: set[tuple[int, int]] = set()
    for _ in range(BALANCE_ROUNDS // 2):  # groups are cut only for what no whole group can even out
        cut = to_cut(state, shards, cut)
        state, more = balance(state, shards, turn, cut)
        turn += 1
        if not more:
            break
    out = slots(state)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
