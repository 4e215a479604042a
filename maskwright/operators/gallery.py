"""Maintaining the gallery as keyed tables: look-ups, upserts, the mutation log, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.lineage import cut
from maskwright.operators import scan


def _finite(column: str):
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def find_people(requests: DataFrame, people: DataFrame) -> DataFrame:
    """First directory person whose name or alias equals each requested name.

    ``requests(name)``, ``people(person_ord, id, name, aliases)``; adds ``person_id``,
    null when nobody fits.
    """
    empty = F.array().cast("array<string>")
    labels = people.select(
        "person_ord",
        "id",
        F.explode(F.array_union(F.array("name"), F.coalesce("aliases", empty))).alias("label"),
    ).where("label is not null")
    first = (
        labels.groupBy(text.normalize_name(F.col("label")).alias("__wanted"))
        .agg(F.min_by("id", "person_ord").alias("person_id"))
    )
    return (
        requests.withColumn("__wanted", text.normalize_name(F.col("name")))
        .join(first, "__wanted", "left")
        .drop("__wanted")
    )


#: Requests that one task sorts.
LOOKUP_ROWS = 250_000


def choose_target(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """Which stored identity a preview refreshes.

    ``requests(request_id, name, explicit_id, canonical_id)``; adds ``identity_id`` (null
    for a new person) and ``error``. Priority: the explicit id, which must exist, then
    the canonical id, the name's slug, the earliest identity with the same name.
    """
    ids = identities.select("identity_id").distinct()
    by_name = identities.groupBy(text.normalize_name(F.col("name")).alias("__wanted")).agg(
        F.min_by("identity_id", "identity_ord").alias("__by_name")
    )

    shuffled = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, -(-requests.count() // LOOKUP_ROWS))

    def lookup(df: DataFrame, column: str, known: DataFrame, key: str, value: str, out: str) -> DataFrame:
        """Sorted on both sides: a hash table of all identities would lie in every task. Rows
        without a key are spread, so that they do not meet in one task."""
        none = F.when(F.col(column).isNull(), 1 + F.pmod(F.xxhash64("request_id"), F.lit(10_007)))
        at = lambda c, spread: F.struct(F.coalesce(c, F.lit("")).alias("key"), spread.cast("bigint").alias("none"))
        own = known.where(F.col(key).isNotNull()).select(at(key, F.lit(0)).alias("__at"), F.col(value).alias(out))
        asked = df.withColumn("__at", at(column, F.coalesce(none, F.lit(0))))
        asked, own = asked.repartition(parts, "__at"), own.repartition(parts, "__at")
        return asked.join(own.hint("merge"), "__at", "left").drop("__at")

    found = (
        requests.withColumn("__explicit", F.when(F.col("explicit_id") != "", F.col("explicit_id")))
        .withColumn("__slug", text.identity_id(F.col("name")))
        .withColumn("__wanted", text.normalize_name(F.col("name")))
    )
    for column, out in (("__explicit", "__by_explicit"), ("canonical_id", "__by_canonical"), ("__slug", "__by_slug")):
        found = lookup(found, column, ids, "identity_id", "identity_id", out)
    found = lookup(found, "__wanted", by_name, "__wanted", "__by_name", "__by_name")
    explicit = F.col("__explicit").isNotNull()
    return found.select(
        *requests.columns,
        F.when(explicit, F.col("__by_explicit"))
        .otherwise(F.coalesce("__by_canonical", "__by_slug", "__by_name"))
        .alias("identity_id"),
        F.when(explicit & F.col("__by_explicit").isNull(), "no such identity").alias("error"),
    )


def upsert(stored: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed identities replace or join the stored ones.

    ``(identity_id, identity_ord, name, threshold, created_at)`` on both sides. A
    replaced identity keeps its place, its finite threshold and its positive creation time.
    """
    new = confirmed.select(*[F.col(c).alias("n_" + c) for c in confirmed.columns])
    both = stored.join(new, stored["identity_id"] == new["n_identity_id"], "full_outer")
    refreshed = F.col("n_identity_id").isNotNull()
    keep_threshold = _finite("threshold") & F.col("identity_id").isNotNull()
    keep_time = F.coalesce(F.col("created_at") > 0, F.lit(False))
    pick = lambda c, keep: F.when(~refreshed | keep, F.col(c)).otherwise(F.col("n_" + c)).alias(c)
    return both.select(
        F.coalesce("identity_id", "n_identity_id").alias("identity_id"),
        F.coalesce("identity_ord", "n_identity_ord").alias("identity_ord"),
        F.when(refreshed, F.col("n_name")).otherwise(F.col("name")).alias("name"),
        pick("threshold", keep_threshold),
        pick("created_at", keep_time),
    )


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("identity_id"), "identity_id", "left_anti")


def set_enabled(meta: DataFrame, enabled: bool) -> DataFrame:
    """The state row after a switch; an unchanged switch does not bump the revision."""
    same = F.col("enabled") == F.lit(enabled)
    return meta.select(
        F.lit(enabled).alias("enabled"),
        F.when(same, F.col("revision")).otherwise(F.col("revision") + 1).alias("revision"),
    )


def replay(log: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Judge every mutation as if applied one after the other.

    ``log(seq, op, identity_id, explicit, enabled, threshold, created_at)`` with op
    CONFIRM, REMOVE or SET_ENABLED. Adds ``effective`` (false for a no-op or a refused
    refresh), the ``revision`` after it, and ``epoch``: how often its identity had been
    removed before. Everything is a running value, so neither the log nor a much-edited
    identity is handled by one task.
    """
    ranges = scan.plan_ranges(log, "seq", range_rows)
    switch = F.col("op") == "SET_ENABLED"
    removal = F.when(F.col("op") == "REMOVE", F.lit(0))
    creation = F.when((F.col("op") == "CONFIRM") & ~F.col("explicit"), F.lit(1))
    edits = scan.running(
        log.where(~switch),
        ["identity_id"],
        ["seq"],
        lasts={"__was": F.coalesce(removal, creation)},
        inclusive=False,
        ranges=ranges,
    )
    present = F.coalesce(F.col("__was"), F.lit(0)) == 1
    edits = edits.withColumn(
        "effective", F.when(F.col("op") == "REMOVE", present).otherwise(~F.col("explicit") | present)
    )
    switches = scan.running(
        log.where(switch),
        [],
        ["seq"],
        lasts={"__was": F.col("enabled").cast("int")},
        inclusive=False,
        ranges=ranges,
    ).withColumn("effective", F.col("enabled").cast("int") != F.coalesce("__was", F.lit(1)))
    judged = cut(edits.unionByName(switches).drop("__was"))
    state = scan.running(
        judged, [], ["seq"], sums={"revision": F.col("effective").cast("bigint")}, ranges=ranges
    )
    removed = (F.col("op") == "REMOVE") & F.col("effective")
    return scan.running(
        state,
        ["identity_id"],
        ["seq"],
        sums={"epoch": removed.cast("bigint")},
        inclusive=False,
        ranges=ranges,
    )


def gallery_after(replayed: DataFrame) -> DataFrame:
    """Identities present at the end of a replayed log.

    Within its last life an identity keeps the first finite threshold and the first
    positive creation time it was confirmed with; everything else comes from the last
    confirmation. Plain aggregations, combined map-side.
    """
    ops = replayed.where("op <> 'SET_ENABLED' and effective")
    lives = ops.groupBy("identity_id", "epoch").agg(
        F.max_by("op", "seq").alias("last_op"),
        F.min_by("threshold", F.when(_finite("threshold"), F.col("seq"))).alias("first_threshold"),
        F.max_by("threshold", "seq").alias("last_threshold"),
        F.min_by("created_at", F.when(F.col("created_at") > 0, F.col("seq"))).alias("first_time"),
        F.max_by("created_at", "seq").alias("last_time"),
        F.max("seq").alias("last_seq"),
        F.max("revision").alias("revision"),
    )
    return lives.where("last_op = 'CONFIRM'").select(
        "identity_id",
        F.coalesce("first_threshold", "last_threshold").alias("threshold"),
        F.coalesce("first_time", "last_time").alias("created_at"),
        "last_seq",
        "revision",
    )


def unprocessed(media: DataFrame, results: DataFrame, revision: int, key: str = "media_url") -> DataFrame:
    """Media without a result at this revision; a new revision invalidates every result."""
    done = results.where(F.col("revision") == revision).select(key)
    return media.join(done, key, "left_anti")


def current_only(replies: DataFrame, current: DataFrame) -> DataFrame:
    """Replies whose token and revision are still the current ones of their medium."""
    return replies.join(current.select("media_id", "token", "revision"), ["media_id", "token", "revision"])
