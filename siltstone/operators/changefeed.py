"""Replay of a change feed into the current state of a keyed table (problem 2).

A change is one numbered transaction of an entry: it removes some UIDs and adds others. Changes arrive in
batches, late, out of order and repeatedly. The store

* assembles every transaction from its deliveries (their lists are united, so a repetition adds nothing),
* holds a change back while a number before it is missing, and exposes state only up to the contiguous
  watermark of its entry; :meth:`ChangeStore.close` declares the remaining gaps void and releases the rest,
* replays conflicting changes in order of their number: changes conflict only if they touch the same
  (entry, uid), so each such pair is its own line of replay and all pairs run in parallel. The outcome on a
  pair is what the highest-numbered change that mentions it says, which is an aggregate (max of number and
  deed) that combines map-side. No task ever holds an entry, so an entry with a third of all changes is
  spread over all tasks.

Applied batches are appended as small folders: the last deeds on the pairs (entry, uid) that they touch, and the
watermarks and flags that they change. Readers merge them; once ``FOLDERS`` have come together, the next batch
rewrites them as one and removes what no version names any more, so what a batch and a reader see stays level.
Every batch is published by one atomic commit.

Defined results: a change without entry or number can't be ordered and is left out. Null UIDs are left out.
A UID in both lists of a change is removed. A null flag is false. An entry with any applied change whose
flag is true keeps a count only and holds no UID. Numbers start at ``first_seq``; lower ones count as
contiguous with it. Deliveries that disagree are united: flags by or, lists by union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.storage import SnapshotStore, children, fresh_path

WORD = 32
BLOCK = WORD * WORD
SALTS = 32
FOLDERS = 12

CHANGES = "entry {}, seq bigint, adds array<string>, removes array<string>, flag boolean"
STATE = "entry {}, uid string, last bigint, held boolean"
ENTRIES = "entry {}, watermark bigint, flagged boolean"


def trailing_ones(word: Column) -> Column:
    """Number of ones at the low end of a word of 32 bits held in a long."""
    free = F.bitwise_not(word)
    return F.bit_count(free.bitwiseAND(-free) - F.lit(1)).cast("long")


def contiguous(seqs: DataFrame, base: Column | int) -> DataFrame:
    """entry, watermark: the highest number w of an entry such that all of base+1..w occur.

    ``seqs`` has entry and seq, with or without repetitions. Numbers become bits of words, words bits of
    blocks, by two aggregations that combine map-side; only one row per block of 1024 numbers reaches the
    ordered step.
    """
    n = F.col("seq") - base - 1
    words = (
        seqs.select("entry", n.alias("n")).where("n >= 0")
        .groupBy("entry", F.expr("n div 32").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(n % 32 as int))")).alias("bits"))
    )
    full = F.lit((1 << WORD) - 1)
    blocks = (
        words.withColumn("ones", trailing_ones(F.col("bits")))
        .groupBy("entry", F.expr("word div 32").alias("block"))
        .agg(
            F.bit_or(F.when(F.col("bits") == full, F.expr("shiftleft(1L, cast(word % 32 as int))")).otherwise(F.lit(0).cast("long"))).alias("full"),
            F.map_from_entries(F.collect_list(F.struct(F.expr("word % 32"), F.col("ones")))).alias("ones"),  # at most 32
        )
        .withColumn("whole", trailing_ones(F.col("full")))
        .select("entry", "block", (F.col("whole") * WORD + F.coalesce(F.try_element_at("ones", F.col("whole")), F.lit(0))).alias("run"))
    )
    w = Window.partitionBy("entry").orderBy("block")
    unbroken = (F.row_number().over(w) - 1 == F.col("block")) & (F.coalesce(F.min("run").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(BLOCK)) == BLOCK)
    return blocks.withColumn("unbroken", unbroken).where("unbroken").groupBy("entry").agg((F.max(F.col("block") * BLOCK + F.col("run")) + base).alias("watermark"))


class ChangeStore:
    """State of a change feed under ``path``; see the module for what it does. ``key`` is the Spark type of entries."""

    def __init__(self, spark: SparkSession, path: str | None = None, first_seq: int = 1, key: str = "bigint"):
        self.spark, self.base = spark, first_seq - 1
        self.store = SnapshotStore(spark, path or fresh_path(spark, "changes"))
        self.key = self.store.manifest["meta"].get("key", key)
        self.changes_of, self.state_of, self.entries_of = (T.StructType.fromDDL(x.format(self.key)) for x in (CHANGES, STATE, ENTRIES))

    def apply(self, batch: DataFrame, entry: str, seq: str, adds: str, removes: str, flag: str) -> None:
        """Add a batch of deliveries; the names are its columns, any others are ignored."""
        none = F.array().cast("array<string>")
        new = batch.select(
            F.col(entry).cast(self.key).alias("entry"),
            F.col(seq).cast("long").alias("seq"),
            F.coalesce(F.col(adds), none).alias("adds"),
            F.coalesce(F.col(removes), none).alias("removes"),
            F.coalesce(F.col(flag), F.lit(False)).alias("flag"),
        ).where("entry is not null and seq is not null")
        if len(self.store.parts("state")) >= FOLDERS:
            self.compact()
            self.store.vacuum()
        self._replay(new.unionByName(self.store.read("pending", self.changes_of)), closing=False)

    def close(self) -> None:
        """Declare the numbers that are still missing void and apply all changes that were held."""
        self._replay(self.store.read("pending", self.changes_of), closing=True)

    def _replay(self, changes: DataFrame, closing: bool) -> None:
        if closing:
            # Held changes were assembled by the batch that held them.
            ready, held = changes, None
            marks = changes.groupBy("entry").agg(F.max("seq").alias("watermark"))
        else:
            whole = self._assembled(changes)
            marks = self._marks(whole)
            ready, held = self._split(whole, marks)
        state_dir, entry_dir = self.store.next_dir("state"), self.store.next_dir("entries")
        deeds = ready.select(
            "entry", "seq",
            F.explode(F.concat(
                F.transform("removes", lambda u: F.struct(u.alias("uid"), F.lit(1).alias("removed"))),
                F.transform(F.array_except("adds", "removes"), lambda u: F.struct(u.alias("uid"), F.lit(0).alias("removed"))),
            )).alias("d"),
        )
        # In a change that mentions a UID twice (deliveries that disagree), removal wins: number and deed as one
        # decimal, of which the largest counts, is a hash aggregation that combines map-side.
        deed = F.col("seq").cast("decimal(19,0)") * 2 + F.col("d.removed")
        last = F.col("m").cast("decimal(21,0)")
        gone = F.pmod(last, F.lit(2)) == 1
        deeds.groupBy("entry", F.col("d.uid").alias("uid")).agg(F.max(deed).alias("m")).select(
            "entry", "uid", ((last - gone.cast("int")) / 2).cast("long").alias("last"), (~gone).alias("held")
        ).write.parquet(state_dir)
        flags = ready.where("flag").select("entry", F.lit(None).cast("long").alias("watermark"), F.lit(True).alias("flagged")).distinct()
        moved = marks if closing else marks.where("known is null or watermark > known")
        moved.select("entry", "watermark", F.lit(False).alias("flagged")).unionByName(flags).write.parquet(entry_dir)
        v = str(self.store.version + 1)
        parts = {
            "state": {**self.store.parts("state"), v: {"dir": state_dir}},
            "entries": {**self.store.parts("entries"), v: {"dir": entry_dir}},
            "pending": {},
        }
        if held is not None:
            parts["pending"] = {v: {"dir": held}}
        self.store.commit(parts, {"key": self.key})

    def _assembled(self, changes: DataFrame) -> DataFrame:
        """Every change once, written first, since several steps read it."""
        folder = self.store.next_dir("assembled")
        lists = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
        whole = changes.select("entry", "seq", lists(F.col("adds")).alias("adds"), lists(F.col("removes")).alias("removes"), "flag")
        # Deliveries of a change agree but for order, so equal rows are dropped; ones that don't agree stay
        # side by side, which unites them, since replay takes the maximum over (number, deed).
        whole.dropDuplicates(["entry", "seq", "adds", "removes", "flag"]).write.parquet(folder)
        return self.spark.read.schema(self.changes_of).parquet(folder)

    def _marks(self, whole: DataFrame) -> DataFrame:
        """entry, watermark, known: of the entries of ``whole``, how far they reach now, and what was known."""
        seqs = whole.select("entry", "seq")
        if not self.store.parts("entries"):
            marks = contiguous(seqs, self.base).withColumn("known", F.lit(None).cast("long"))
        else:
            # A stored watermark w stands for all numbers up to w: shift each entry by its own base.
            known = self.entries().select("entry", F.col("watermark").alias("known"))
            seqs = seqs.join(known, "entry", "left").select("entry", (F.col("seq") - F.coalesce("known", F.lit(self.base))).alias("seq"))
            new = contiguous(seqs, 0)
            marks = whole.select("entry").distinct().join(new, "entry", "left").join(known, "entry", "left")
            marks = marks.select("entry", (F.coalesce("watermark", F.lit(0)) + F.coalesce("known", F.lit(self.base))).alias("watermark"), "known")
        folder = self.store.next_dir("marks")
        marks.write.parquet(folder)
        return self.spark.read.schema(f"entry {self.key}, watermark long, known long").parquet(folder)

    def _split(self, whole: DataFrame, marks: DataFrame) -> tuple[DataFrame, str | None]:
        """The changes up to their watermarks, and the folder of those that must wait; written once."""
        both = whole.join(marks.select("entry", "watermark"), "entry", "left").withColumn("ready", F.col("seq") <= F.coalesce("watermark", F.lit(self.base)))
        split = self.store.next_dir("pending")
        both.select(*self.changes_of.names, "ready").write.partitionBy("ready").parquet(split)
        made = children(self.spark, split)
        ready = self.spark.read.schema(self.changes_of).parquet(f"{split}/ready=true") if "ready=true" in made else whole.limit(0)
        return ready, f"{split}/ready=false" if "ready=false" in made else None

    def entries(self) -> DataFrame:
        """entry, watermark, flagged: how far each entry has been applied, and whether it keeps a count only."""
        return self.store.read("entries", self.entries_of).groupBy("entry").agg(F.max("watermark").alias("watermark"), F.bool_or("flagged").alias("flagged"))

    def _state(self) -> DataFrame:
        """The last deed on every pair, over all folders."""
        state = self.store.read("state", self.state_of)
        if len(self.store.parts("state")) < 2:
            return state
        deed = F.col("last").cast("decimal(19,0)") * 2 + (~F.col("held")).cast("int")
        gone = F.pmod(F.col("m"), F.lit(2)) == 1
        return state.groupBy("entry", "uid").agg(F.max(deed).alias("m")).select("entry", "uid", ((F.col("m") - gone.cast("int")) / 2).cast("long").alias("last"), (~gone).alias("held"))

    def current(self) -> DataFrame:
        """entry, uid: the UIDs that each entry holds at its watermark."""
        counted = self.store.read("entries", self.entries_of).where("flagged").select("entry").distinct()
        # An entry may hold a third of all UIDs: the anti join runs on (entry, salt of the UID).
        salted = counted.select("entry", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return self._state().where("held").withColumn("salt", F.pmod(F.hash("uid"), F.lit(SALTS))).join(salted, ["entry", "salt"], "left_anti").select("entry", "uid")

    def compact(self) -> None:
        """Rewrite all applied folders as one."""
        state_dir, entry_dir, v = self.store.next_dir("state"), self.store.next_dir("entries"), str(self.store.version + 1)
        self._state().write.parquet(state_dir)
        self.entries().write.parquet(entry_dir)
        self.store.commit({"state": {v: {"dir": state_dir}}, "entries": {v: {"dir": entry_dir}}})
