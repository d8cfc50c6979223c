"""Activity sessions, kept incrementally (problem 1).

A session is a maximal run of one user's events in which neighbours lie at most ``gap_ms`` apart. The
store takes batches of events in any order. Each batch is reduced to local sessions, these are compared
with the stored sessions that lie within the gap, bridged ones are merged, and the parts that hold the
affected rows are replaced by one atomic commit.

No key can overload a task: two events in one time slot of width ``gap_ms`` always belong together, so the
first step is a hash aggregation on (user, slot), which combines map-side whatever the skew. What reaches
the ordered step per user is at most one row per slot: the covered time divided by the gap, however many
events a user has.

Defined results: events without user (null, or blanks only) or time are left out. Users are compared
trimmed and lower-cased. Rows with one id are one event; should they disagree, the earliest (time, user)
holds; an id that an earlier batch stored, at a time in a period of the present one, keeps what that batch
said (an event's time stays the same, so an id that comes again does so in its period). Rows without id are one event per (user, time). A negative or huge time is a time like any other. An empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.storage import SnapshotStore, children, fresh_path

GAP_MS = 1_800_000
PERIOD_MS = 28 * 86_400_000
FOLDERS = 8

EVENTS = T.StructType([T.StructField("user", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("id", T.StringType())])
SESSIONS = T.StructType(
    [T.StructField("user", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n", T.LongType())]
)


def clean_user(user: Column) -> Column:
    """Lower-cased and without blanks at both ends; null where nothing is left."""
    u = F.lower(F.regexp_replace(user, r"(?U)^\s+|\s+$", ""))
    return F.when(u != "", u)


def slot_of(ts: str, width: int) -> Column:
    """Number of the slot of ``width`` that holds ``ts``; whole numbers only, so exact for every long."""
    return F.expr(f"`{ts}` div {width}L - CASE WHEN `{ts}` % {width}L < 0 THEN 1 ELSE 0 END")


def merge_sessions(rows: DataFrame, gap_ms: int) -> DataFrame:
    """Merge intervals (user, start, end, n) of each user that overlap or lie within the gap."""
    w = Window.partitionBy("user").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.try_subtract("start", before) > gap_ms, F.lit(True))  # null: first row, or too far apart for a long
    return (
        rows.withColumn("opens", opens.cast("int"))
        .withColumn("k", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("user", "k")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .drop("k")
    )


class SessionStore:
    """Sessions under ``path``; see the module for what they are.

    Both event ids and sessions lie in periods of ``period_ms``, ids by the time of their event and sessions by
    their end, sessions moreover in ``buckets`` of users. A batch reads and replaces only the (period, bucket)
    pairs that its own slots, widened by the gap, can touch: a single late or wrong time adds its own period and
    no other. Ids of a period are appended, and rewritten as one folder whenever ``FOLDERS`` have come together.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, gap_ms: int = GAP_MS, period_ms: int = PERIOD_MS, buckets: int = 1):
        self.spark, self.gap, self.period, self.buckets = spark, gap_ms, period_ms, buckets
        self.store = SnapshotStore(spark, path or fresh_path(spark, "sessions"))

    def apply(self, batch: DataFrame, user: str, ts: str, event_id: str) -> None:
        """Add a batch of events; the three names are its columns, any others are ignored."""
        u, t = clean_user(F.col(user)), F.col(ts).cast("long")
        events = batch.select(u.alias("user"), t.alias("ts"), F.col(event_id).cast("string").alias("id"))
        events = events.where(F.col("user").isNotNull() & F.col("ts").isNotNull())
        key = F.coalesce(F.concat(F.lit("="), F.col("id")), F.concat_ws("\x00", F.lit(""), F.col("ts").cast("string"), F.col("user")))
        events = (
            events.select(F.struct("ts", "user").alias("e"), key.alias("id"))
            .groupBy("id").agg(F.min("e").alias("e"))
            .select(F.col("e.user").alias("user"), F.col("e.ts").alias("ts"), "id")
            .withColumn("part", slot_of("ts", self.period))
        )
        touched = self._write(events, "staged")
        known = {k: p for k, p in self.store.parts("events").items() if k.partition("@")[0] in touched}
        if known:
            ids = self.store.read("events", EVENTS, list(known)).select("id")
            whole = self.spark.read.schema(EVENTS).parquet(*touched.values())
            fresh = self._write(whole.join(ids, "id", "left_anti").withColumn("part", slot_of("ts", self.period)), "events")
        else:
            fresh = touched
        if not fresh:
            return
        new = self.spark.read.schema(EVENTS).parquet(*fresh.values())
        slots = (
            new.groupBy("user", slot_of("ts", self.gap).alias("slot"))
            .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
            .drop("slot")
        )
        have = self.store.parts("sessions")
        near = self._near(fresh, have)
        if near:
            slots = merge_sessions(slots, self.gap).unionByName(self.store.read("sessions", SESSIONS, near))
        merged = merge_sessions(slots, self.gap).withColumns({"part": slot_of("end", self.period), "bucket": self._bucket()})
        out = self.store.next_dir("sessions")
        merged.hint("rebalance", "part", "bucket").write.partitionBy("part", "bucket").parquet(out)
        # One row per pair: their number is bounded by the covered time and the number of buckets.
        stats = self.spark.read.parquet(out).groupBy("part", "bucket").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).collect()
        v = self.store.version + 1
        parts = {k: p for k, p in have.items() if k not in near}
        parts |= {f"{r['part']}/{r['bucket']}@{v}": {"dir": f"{out}/part={r['part']}/bucket={r['bucket']}", "lo": r["lo"], "hi": r["hi"]} for r in stats}
        self.store.commit({"events": self._ids(fresh, v), "sessions": parts})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("user"), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, component: str) -> dict[str, str]:
        """{period: folder} of the rows of ``df``, which has their period as ``part``."""
        folder = self.store.next_dir(component)
        df.select("user", "ts", "id", "part").write.partitionBy("part").parquet(folder)
        return {name.partition("=")[2]: f"{folder}/{name}" for name in children(self.spark, folder) if name.startswith("part=")}

    def _near(self, fresh: dict[str, str], have: dict[str, dict]) -> list[str]:
        """The stored parts that may hold sessions within the gap of a new event, by period, span and bucket of users."""
        spans = [(int(k) * self.period - self.gap, (int(k) + 1) * self.period + self.gap) for k in fresh]
        near = [k for k, p in have.items() if any(p["lo"] <= hi and p["hi"] >= lo for lo, hi in spans)]
        if not near or self.buckets == 1:
            return near
        new = self.spark.read.schema(EVENTS).parquet(*fresh.values())
        seen = {str(r["bucket"]) for r in new.select(self._bucket().alias("bucket")).distinct().collect()}
        return [k for k in near if k.partition("@")[0].partition("/")[2] in seen]

    def _ids(self, fresh: dict[str, str], version: int) -> dict[str, dict]:
        """The folders of ids with those of a batch; a period with many is rewritten as one."""
        parts = dict(self.store.parts("events")) | {f"{k}@{version}": {"dir": d} for k, d in fresh.items()}
        of = lambda k: [x for x in parts if x.partition("@")[0] == k]
        full = [k for k in fresh if len(of(k)) >= FOLDERS]
        if full:
            old = [x for k in full for x in of(k)]
            whole = self.spark.read.schema(EVENTS).parquet(*[parts[x]["dir"] for x in old])
            one = self._write(whole.withColumn("part", slot_of("ts", self.period)).hint("rebalance", "part"), "events")
            parts = {k: p for k, p in parts.items() if k not in old} | {f"{k}@{version}": {"dir": d} for k, d in one.items()}
        return parts

    def sessions(self) -> DataFrame:
        """user, start_ms, end_ms, duration_ms, n_events of every session."""
        return self.store.read("sessions", SESSIONS).select(
            "user", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.try_subtract("end", "start").alias("duration_ms"), F.col("n").alias("n_events")
        )


def arrival_batches(df: DataFrame, arrived: str, n: int) -> list[DataFrame]:
    """``df`` cut into ``n`` batches of equal spans of arrival; rows without arrival come first."""
    lo, hi = df.agg(F.min(arrived), F.max(arrived)).first()
    if lo is None or lo == hi:
        return [df]
    cuts = [lo + (hi - lo) * k / n for k in range(1, n)]
    kind = df.schema[arrived].dataType
    at = [F.lit(c).cast(kind) for c in cuts]
    out = [df.where(F.col(arrived).isNull() | (F.col(arrived) < at[0]))]
    out += [df.where((F.col(arrived) >= a) & (F.col(arrived) < b)) for a, b in zip(at, at[1:])]
    return [*out, df.where(F.col(arrived) >= at[-1])]
