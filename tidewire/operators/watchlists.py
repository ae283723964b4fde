"""Watchlists replayed in order: adds up to the free cap, removals and changes of tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tiers without a cap, and the cap of the free one.
UNCAPPED, FREE_CAP = ("PRO", "RESEARCH"), 5
ADD, REMOVE, TIER = "ADD", "REMOVE", "TIER"


def watchlist_replay(events: DataFrame, users: DataFrame | None = None, cap: int = FREE_CAP) -> DataFrame:
    """id, user_id, player_id, action, accepted, was_created, held: every event of a user in order of time and id.

    events: id, user_id, player_id, action (ADD, REMOVE, TIER), tier (of TIER), created_at; users: id, tier at the start, else FREE. An add is refused if the
    user's tier has a cap, the cap is reached and the player is not held; adding a held player is accepted and creates nothing. A
    removal always succeeds. After a step down to FREE all that is held stays, and new players are refused until fewer than the cap are held.
    held: the players on the list after the event.

    Events are sorted within a user by the shuffle and pass once, a batch at a time; held is the set of one user's players, at most the
    catalogue. So a user with very many events is one long task in constant memory. A null user is a user; unknown actions change nothing and are not accepted.
    """
    rows = events.select("id", "user_id", "player_id", "action", "tier", "created_at")
    if users is not None:
        start = users.groupBy(F.col("id").alias("_u")).agg(F.min("tier").alias("_tier"))
        rows = rows.join(start, F.col("user_id") == F.col("_u"), "left").drop("_u")
    else:
        rows = rows.withColumn("_tier", F.lit(None).cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        import pyarrow as pa

        user, free, held, started = None, True, set(), False
        for batch in batches:
            accepted, created, size = [], [], []
            for who, player, action, to, first in zip(*(batch.column(c).to_pylist() for c in ("user_id", "player_id", "action", "tier", "_tier")), strict=True):
                if not started or who != user:
                    user, held, started = who, set(), True
                    free = first not in UNCAPPED
                ok, new = action in (ADD, REMOVE, TIER), False
                if action == ADD:
                    new = player not in held
                    ok = not (free and new and len(held) >= cap)
                    new = new and ok
                    if ok:
                        held.add(player)
                elif action == REMOVE:
                    held.discard(player)
                elif action == TIER:
                    free = to not in UNCAPPED
                accepted.append(ok)
                created.append(new)
                size.append(len(held))
            columns = [batch.column(c) for c in ("id", "user_id", "player_id", "action")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(accepted, pa.bool_()), pa.array(created, pa.bool_()), pa.array(size, pa.int64())], ["id", "user_id", "player_id", "action", "accepted", "was_created", "held"])

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "created_at", "id")
    return ordered.mapInArrow(run, f"id {kinds['id']}, user_id {kinds['user_id']}, player_id {kinds['player_id']}, action string, accepted boolean, was_created boolean, held long")


def watchlist_admission(adds: DataFrame, cap: int = FREE_CAP) -> DataFrame:
    """The adds alone, all users free: id, user_id, player_id, accepted, was_created."""
    return watchlist_replay(adds.withColumns({"action": F.lit(ADD), "tier": F.lit(None).cast("string")}), cap=cap).select("id", "user_id", "player_id", "accepted", "was_created")
