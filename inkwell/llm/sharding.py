"""Shards of equal row counts by balanced label propagation, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.operators.ordering import dense_index
from inkwell.operators.skew import HOT_ROWS, join_unique
from inkwell.session import stage

SHARDS = 16
ROUNDS = 8
#: A shard with less than this share of its places free takes no more linked rows.
LEAST_ROOM = 0.05
GRAIN = 1 << 20


def _accepted(moves: dict[tuple[int, int], int], load: list[int], capacity: int) -> list[float]:
    """The share of the proposed moves from shard a to b (at a * shards + b) that keeps loads within capacity.

    Moves both ways between two shards cancel out; what is left shares the free room of its target.
    """
    shards = len(load)
    paired = {(a, b): min(n, moves.get((b, a), 0)) for (a, b), n in moves.items()}
    wanting = [sum(n - paired[a, b] for (a, b), n in moves.items() if b == target) for target in range(shards)]
    shares = [0.0] * (shards * shards)
    for (a, b), n in moves.items():
        room = max(0, capacity - load[b])
        fit = min(1.0, room / wanting[b]) if wanting[b] else 0.0
        shares[a * shards + b] = (paired[a, b] + (n - paired[a, b]) * fit) / n
    return shares


def _tallies(state: DataFrame, shards: int, hot_rows: int) -> DataFrame:
    """Per node: its shard, its key for ties, and how many members its groups have in each shard.

    Groups are counted per shard first, so a group of any size is one short row; members find that
    row by a join that salts hot groups. No two members are ever paired.
    """
    counts = state.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    per_shard = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in range(shards)]
    votes = stage(counts.groupBy("grp").agg(*per_shard), "shard-votes")
    met = join_unique(state, votes, "grp", hot_rows=hot_rows, stable_left=True)
    summed = met.groupBy("node").agg(
        F.min("shard").alias("shard"), F.min("tie").alias("tie"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)]
    )
    return summed


def _proposals(tallies: DataFrame, open_shards: list[bool]) -> DataFrame:
    """Each node's best shard among the open ones and its own; equal counts by a rotation all members share."""
    shards = len(open_shards)

    def rank(s: int) -> Column:
        usable = F.lit(True) if open_shards[s] else F.col("shard") == s
        turn = F.pmod(F.col("tie") + F.lit(s), F.lit(shards))
        return F.struct(F.when(usable, F.col(f"n{s}")).otherwise(-1).alias("n"), turn.alias("turn"), F.lit(s).alias("s"))

    best = F.array_max(F.array(*[rank(s) for s in range(shards)])).getField("s")
    return tallies.select("node", "shard", best.alias("best"))


def propagate(links: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, shard, tie) of every node that has a link; `links` are (node, grp) memberships.

    Starts from hashed shards. In each round nodes ask to move to the shard where their groups have
    most members; at most shards x shards counts of such moves come to the driver, which answers with the
    share of each that the capacity allows, and a hash of the node decides who goes.
    """
    tie = F.min(F.pmod(F.xxhash64("grp"), F.lit(1 << 31))).alias("tie")
    first = links.groupBy("node").agg(tie).withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    labels = stage(first, "shard-labels")
    for turn in range(rounds):
        load = [0] * shards
        for row in labels.groupBy("shard").count().collect():
            load[row["shard"]] = row["count"]
        state = stage(links.join(labels, "node"), "shard-state")
        asked = stage(_proposals(_tallies(state, shards, hot_rows), [n < capacity * (1 - LEAST_ROOM) for n in load]), "shard-moves")
        pairs = asked.filter(F.col("best") != F.col("shard")).groupBy("shard", "best").count().collect()
        if not pairs:
            break
        shares = _accepted({(r["shard"], r["best"]): r["count"] for r in pairs}, load, capacity)
        share = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("shard") * shards + F.col("best") + 1)
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(GRAIN)) / F.lit(float(GRAIN))
        goes = (F.col("best") != F.col("shard")) & (drawn < share)
        moved = asked.select("node", F.when(goes, F.col("best")).otherwise(F.col("shard")).alias("shard"))
        labels = stage(moved.join(labels.select("node", "tie"), "node"), "shard-labels")
    return labels


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def balance(rows: DataFrame, labels: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`rows` (unique long `node`) with `shard` and `slot`: counts at most one apart, slots gapless from 0.

    All rows are numbered once in the order shard, group, node, with the unlinked ones last. A shard
    keeps its first rows up to its quota; the others and the unlinked ones fill the remaining
    places in order, which cuts as few groups as the quotas leave.
    """
    placed = join_unique(rows, labels, "node", "left", stable_left=True)
    placed = placed.withColumn("_at", F.coalesce("shard", F.lit(shards))).withColumn("_tie", F.coalesce("tie", F.lit(0))).drop("shard", "tie")
    numbered = stage(dense_index(placed, ["_at", "_tie", "node"], "_index", offset=0), "shard-order")
    held = [0] * (shards + 1)
    for row in numbered.groupBy("_at").count().collect():
        held[row["_at"]] = row["count"]
    total = sum(held)
    quota = [total // shards + (s < total % shards) for s in range(shards)] + [0]
    starts = [sum(held[:s]) for s in range(shards + 1)]
    keeps = [min(h, q) for h, q in zip(held, quota)]
    spills = [h - k for h, k in zip(held, keeps)]
    spill_starts = [sum(spills[:s]) for s in range(shards + 1)]
    gaps = [quota[s] - keeps[s] for s in range(shards)]
    gap_starts = [sum(gaps[:s]) for s in range(shards)]
    place = F.col("_index") - _pick(starts, F.col("_at"))
    stays = place < _pick(keeps, F.col("_at"))
    spill = _pick(spill_starts, F.col("_at")) + place - _pick(keeps, F.col("_at"))
    target = F.lit(0)
    for s in range(shards):
        if gaps[s]:
            target = F.when(F.col("_spill") >= gap_starts[s], F.lit(s)).otherwise(target)
    result = numbered.withColumn("_place", place).withColumn("_stays", stays).withColumn("_spill", spill).withColumn("_target", target)
    shard = F.when(F.col("_stays"), F.col("_at")).otherwise(F.col("_target")).cast("int")
    slot = F.when(F.col("_stays"), F.col("_place")).otherwise(
        _pick(keeps[:shards], F.col("_target")) + F.col("_spill") - _pick(gap_starts, F.col("_target"))
    )
    return result.select(*rows.columns, shard.alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    The law is `rows`: shard counts are at most one apart. Linked documents are those with equal texts
    (null counts as empty); they share a shard as far as quotas allow, so a group larger than a shard
    is spread. Size is the text's UTF-8 bytes plus 1. Rows with null or repeated ids are rows like any
    others; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("node"),
    )
    rows = stage(read, "shard-rows")
    many = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    links = stage(join_unique(rows.select("node", "grp"), stage(many, "shard-groups"), "grp", "left_semi", hot_rows=hot_rows, stable_left=True), "shard-links")
    labels = propagate(links, -(-rows.count() // shards), shards, rounds, hot_rows)
    placed = balance(rows.select("node", "id", "size", "text_crc32"), labels, shards)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
