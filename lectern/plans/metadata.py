"""Tables of sources, documents and jobs: merges, cascades, claims, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TENANT = "default"


def _given(c: Column, kind: str) -> Column:
    """The value, or null where an incoming row says nothing: null, an empty text, list or map."""
    if kind == "string":
        return F.when(c != "", c)
    return F.when(F.size(c) > 0, c) if kind.startswith(("array", "map")) else c


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], fixed: tuple[str, ...] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """``current`` with ``incoming`` rows (unique by ``keys``) merged in; what an incoming row gives wins, maps are united.

    ``fixed`` columns of known rows stay as they are.  ``defaults`` fill what a
    new row doesn't give.  Columns are those of ``current``.
    """
    kinds = dict(current.dtypes)
    old = current.select(*[F.col(c) if c in keys else F.col(c).alias(f"_old_{c}") for c in current.columns], F.lit(True).alias("_known"))
    new = incoming.select(*[F.col(c) if c in keys else F.col(c).alias(f"_new_{c}") for c in incoming.columns])
    joined = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        before = F.col(f"_old_{c}")
        after = _given(F.col(f"_new_{c}"), kinds[c]) if c in incoming.columns else F.lit(None)
        if c in fixed:
            return F.when(F.col("_known"), before).otherwise(after)
        if kinds[c].startswith("map"):
            both = F.map_zip_with(F.coalesce(before, F.create_map().cast(kinds[c])), F.coalesce(after, F.create_map().cast(kinds[c])), lambda _, x, y: F.coalesce(y, x))
            return F.when(before.isNotNull() | after.isNotNull(), both)
        filled = F.coalesce(after, before)
        return F.coalesce(filled, (defaults or {})[c]) if c in (defaults or {}) else filled

    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in current.columns])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys in ``gone``: one anti join each, to be published together."""
    keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}


def principals(presented: DataFrame, keys: DataFrame) -> DataFrame:
    """(request_id, tenant_id, acl, known) of callers: the active key whose hash is that of the one presented.

    Without a key a caller is of the default tenant and sees what is public; a
    wrong or retired key is not known.  ``presented`` (request_id, api_key),
    ``keys`` (key_hash, tenant_id, acl, active).
    """
    live = keys.where("active").select("key_hash", F.col("tenant_id").alias("_tenant"), F.col("acl").alias("_acl"))
    hashed = presented.withColumn("key_hash", F.sha2(F.encode("api_key", "UTF-8"), 256))
    anonymous = F.coalesce(F.col("api_key"), F.lit("")) == ""
    nobody = F.array().cast("array<string>")
    return hashed.join(live, "key_hash", "left").select(
        "request_id",
        F.when(anonymous, DEFAULT_TENANT).otherwise(F.col("_tenant")).alias("tenant_id"),
        F.when(anonymous, nobody).otherwise(F.coalesce("_acl", nobody)).alias("acl"),
        (anonymous | F.col("_tenant").isNotNull()).alias("known"),
    )


def claim(jobs: DataFrame, now: Column, most: int, lease: int = 300) -> DataFrame:
    """The ``most`` jobs that are next: due and free, or held by a lease that ran out; earliest due first, then oldest.

    ``jobs`` (job_id, state, available_at, created_at, lease_until); the result
    has the new ``lease_until``.
    """
    due = (F.col("state") == "pending") & (F.col("available_at") <= now)
    lost = (F.col("state") == "running") & (F.col("lease_until") < now)
    return jobs.where(due | lost).orderBy("available_at", "created_at", "job_id").limit(most).withColumn("lease_until", now + F.make_dt_interval(secs=F.lit(lease)))


def enqueue(jobs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs with one for each wanted key: a failed one becomes pending again, others stay, new keys are added."""
    asked = wanted.select(*keys).distinct()
    again = jobs.join(asked.withColumn("_asked", F.lit(True)), keys, "left")
    kept = again.withColumn("state", F.when(F.col("_asked") & (F.col("state") == "failed"), "pending").otherwise(F.col("state"))).drop("_asked")
    return kept.select(*keys, "state").unionByName(asked.join(jobs.select(*keys), keys, "left_anti").withColumn("state", F.lit("pending")))


def live_workers(beats: DataFrame, now: Column, window: int = 120) -> DataFrame:
    """(worker_id, last) of workers heard of in the last ``window`` seconds."""
    last = beats.groupBy("worker_id").agg(F.max("at").alias("last"))
    return last.where(F.col("last") >= now - F.make_dt_interval(secs=F.lit(window)))


def retired(projections: DataFrame, snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """Projections that nothing needs: retired before the cutoff and before the oldest snapshot still in use, per tenant.

    ``projections`` (tenant_id, active_until, ...), ``snapshots`` (tenant_id, snapshot_at).
    """
    oldest = snapshots.groupBy("tenant_id").agg(F.min("snapshot_at").alias("_oldest"))
    joined = projections.where("active_until IS NOT NULL").join(oldest, "tenant_id", "left")
    return joined.where(F.col("active_until") <= F.least(cutoff, F.coalesce("_oldest", cutoff))).drop("_oldest")


def outstanding(versions: DataFrame, projections: DataFrame, rebuild: bool = False) -> DataFrame:
    """(tenant_id, version_id) of current versions to be built: those without a live projection, or all."""
    current = versions.where("is_current").select("tenant_id", "version_id")
    return current if rebuild else current.join(projections.where("active_until IS NULL").select("version_id").distinct(), "version_id", "left_anti")


def within_limit(asked: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """``asked`` (creator, asked_at, request_id) with ``admitted``: the first of each creator as long as active ones leave room.

    ``active`` has the column creator, a row for each active one.
    """
    held = active.groupBy("creator").agg(F.count("*").alias("_held"))
    order = Window.partitionBy("creator").orderBy("asked_at", "request_id")
    # The window stops at the limit, whatever the creator asks for.
    first = asked.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    ok = first.join(held, "creator", "left").where(F.col("_at") + F.coalesce("_held", F.lit(0)) <= most).select("request_id", F.lit(True).alias("admitted"))
    return asked.join(ok, "request_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def changes(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, event): what an index must be told: added, changed (another value in ``compared``), removed."""
    digest = lambda: F.sha2(F.to_json(F.struct(*compared)), 256)
    joined = before.select(key, digest().alias("_b")).join(after.select(key, digest().alias("_a")), key, "full_outer")
    event = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return joined.select(key, event.alias("event")).where("event IS NOT NULL")


def event_frame(number: Column, event: Column, data: Column) -> Column:
    """One frame of an event stream; without a number it is a keep-alive, which a reader that resumes doesn't count."""
    return F.concat(F.when(number.isNotNull(), F.concat(F.lit("id: "), number.cast("string"), F.lit("\n"))).otherwise(""), F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
