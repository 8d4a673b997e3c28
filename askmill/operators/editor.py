"""Editor events: what a raw change is, and who has switched what on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.plans.ordered import last_known, looking_back
from askmill.schemas import SETTING_FLAGS

WINDOW = 25  # fixed value: events looked at
DELETE_RATIO = NON_EDIT_RATIO = 0.6  # fixed values

INSERT, DELETE, SCROLL, CLICK = "Insert", "Delete", "Scroll", "Click"


def classify_editor_events(raw: DataFrame) -> DataFrame:
    """Add kind and text to raw editor actions; actions that are no event are dropped.

    `action` is change, scroll or click. A change from nothing to something is an Insert, one from
    something to nothing a Delete, and a replacement is no event. A scroll is one if there was a
    view before and its vertical centre has moved. Works on streams too.
    """
    old, new = F.length("old_text"), F.length("new_text")
    change, scroll = F.col("action") == "change", F.col("action") == "scroll"
    moved = F.col("old_center").isNotNull() & (F.col("old_center") != F.col("new_center"))
    inserted, deleted = change & (old == 0) & (new > 0), change & (old > 0) & (new == 0)
    kind = (
        F.when(inserted, INSERT)
        .when(deleted, DELETE)
        .when(scroll & moved, SCROLL)
        .when(F.col("action") == "click", CLICK)
    )
    text = F.when(inserted, F.col("new_text")).when(deleted, F.col("old_text"))
    classified = raw.withColumns({"kind": kind, "text": text}).where(F.col("kind").isNotNull())
    return classified.drop("action", "old_text", "new_text", "old_center", "new_center")


def settings_gate(events: DataFrame, settings: DataFrame, flag: str) -> DataFrame:
    """Pass the events of users who have both automatic queries and `flag` on.

    A user without settings has everything on. `events` may be a stream. Settings with a column ts are
    the changes of users' settings (see `in_force`): those in force at an event's instant count.
    """
    if "ts" in settings.columns:
        return in_force(events, settings, has_on(flag), True)
    # only the users who have switched something off have to be known
    off = settings.where(~has_on(flag)).select("user_id")
    return events.join(off, "user_id", "left_anti")


def window_gate(events: DataFrame, visible: DataFrame) -> DataFrame:
    """Pass the events of users whose tool window is open.

    `visible` has those users; with a column ts it has user_id, ts, seq and a boolean `visible`, the
    times when windows were opened or closed. A window is closed until it is opened.
    """
    if "ts" in visible.columns:
        return in_force(events, visible, F.col("visible"), False)
    return events.join(visible.select("user_id"), "user_id", "left_semi")


def has_on(flag: str) -> Column:
    """Whether a row of settings has both automatic queries and `flag` on."""
    if flag not in SETTING_FLAGS:
        raise ValueError(f"unknown setting {flag!r}")
    return F.coalesce("auto_query", F.lit(True)) & F.coalesce(flag, F.lit(True))


def in_force(events: DataFrame, changes: DataFrame, value: Column, default: bool) -> DataFrame:
    """Pass the events at whose instant the last change of their user made `value` true.

    Events have user_id and ts; changes user_id, ts and seq, which orders the changes of an instant.
    Instants are milliseconds, as in the machines, and a change counts for events of its own. Before a user's first change, and for a null value,
    `default` counts. Both go through one ordered pass per user, in which a hot user is cut into slices.
    """
    row = F.struct(*events.columns)
    state = F.coalesce(value, F.lit(default))
    none = F.lit(None)
    happened = events.select(
        "user_id",
        F.unix_millis("ts").alias("_at"),
        none.cast("long").alias("_seq"),
        none.cast("boolean").alias("_state"),
        row.alias("_row"),
    )
    changed = changes.select(
        "user_id",
        F.unix_millis("ts").alias("_at"),
        F.col("seq").cast("long").alias("_seq"),
        state.alias("_state"),
        none.cast(happened.schema["_row"].dataType).alias("_row"),
    )
    both = happened.unionByName(changed).withColumn("_event", F.col("_row").isNotNull())
    order = ["_at", "_event", "_seq"]
    known = last_known(both, ["user_id"], order, F.col("_state"), "_now")
    return known.where(F.col("_event") & F.coalesce("_now", F.lit(default))).select("_row.*")


def event_mix(
    events: DataFrame, keys: Sequence[str] = ("user_id",), n: int = WINDOW
) -> DataFrame:
    """Edit share and delete ratio over the last n events, from a user's event n + 1 on.

    Counts take in the current event and the n - 1 before it; the edit share divides by n - 1, the
    number that is in the queue while the current one is judged. Inserts at 0 make the ratio 0.
    `hard` marks a delete ratio of at least .6 or an edit share below .6.
    """

    def columns(window):
        recent = window.rowsBetween(1 - n, 0)

        def count(kind: str):
            return F.count(F.when(F.col("kind") == kind, 1)).over(recent)

        return {
            "inserts": count(INSERT),
            "deletes": count(DELETE),
            "_seen": F.count(F.lit(1)).over(window.rowsBetween(-n, 0)),
        }

    slim = events.select(*keys, "ts", "event_id", "kind")
    counted = looking_back(slim, list(keys), ["ts", "event_id"], n, columns)
    ratio = F.when(F.col("inserts") == 0, 0.0).otherwise(
        F.col("deletes") / (F.col("deletes") + F.col("inserts"))
    )
    share = F.col("inserts") / F.lit(float(n - 1)) + F.col("deletes") / F.lit(float(n - 1))
    mixed = counted.where(F.col("_seen") == n + 1).drop("_seen")
    return mixed.withColumns({"delete_ratio": ratio, "edit_share": share}).withColumn(
        "hard", (F.col("delete_ratio") >= DELETE_RATIO) | (F.col("edit_share") < NON_EDIT_RATIO)
    )
