"""Processing only new or changed records, by a ledger of work items.

A work item is one version of one record (a page and its fingerprint). It is *pending* until a worker takes a lease,
*leased* until the lease expires or is committed, and *done* after the commit; an expired lease makes the item pending
again. Every lease carries a fencing token, greater than all before it. Only the holder of an item's greatest token
can finish it: commits of stale tokens are refused when they are made, and of the commits of an item the one with the
greatest token counts; a lease that is never committed takes nothing away from a commit before it. A token's files
have a fixed path, so that a repeated write replaces itself instead of adding rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from heddle.functions.url import page_key
from heddle.session import stage_path

_LEASE = "item string, version string, token bigint, worker string, expires_at timestamp"
_DONE = "item string, version string, token bigint"


def fingerprint(content_hash: Column, content: Column) -> Column:
    """The stored hash, trimmed and lower-cased, or where it is null or empty the md5 of the content (null without either)."""
    stored = F.lower(F.trim(content_hash, F.lit(" \t\r\n")))
    return F.coalesce(F.when(stored != "", stored), F.md5(content))


def newest_states(store: DataFrame) -> DataFrame:
    """(item, rec_id, version): of each page the state with the greatest last_crawled (of equal ones the greatest
    rec_id; a null time is before all others). Rows without url are no pages. States delivered twice count once.
    """
    states = store.where(F.col("url").isNotNull()).select(page_key(F.col("url")).alias("item"), "rec_id", "last_crawled", fingerprint(F.col("content_hash"), F.col("content")).alias("version"))
    newest = states.groupBy("item").agg(F.max(F.struct("last_crawled", "rec_id", "version")).alias("s"))
    return newest.select("item", "s.rec_id", "s.version")


def run_events(processed: DataFrame, runs: DataFrame) -> DataFrame:
    """(item, version, token, worker, expires_at, committed): what the recorded runs leased, and whether they committed it.

    A run's id is its fencing token. A run that succeeded committed all it leased; what a failed, aborted or unknown run
    left behind are leases that are over. Rows without url or run are left out.
    """
    times = [F.col(c) for c in ("finished_at", "started_at") if c in runs.columns] or [F.lit(None).cast("timestamp")]
    known = runs.where("run_id IS NOT NULL").groupBy("run_id").agg(F.bool_or(F.lower(F.trim("status")) == "success").alias("good"), F.max(F.coalesce(*times)).alias("over"))
    rows = processed.where(F.col("url").isNotNull() & F.col("run_id").isNotNull()).join(known, "run_id", "left")
    return rows.select(page_key(F.col("url")).alias("item"), F.lower("content_hash").alias("version"), F.col("run_id").cast("bigint").alias("token"), F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("worker"), F.coalesce("over", F.timestamp_seconds(F.lit(0))).alias("expires_at"), F.coalesce("good", F.lit(False)).alias("committed")).distinct()


def with_states(items: DataFrame, done: DataFrame, leases: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """``items`` with ``state``: 'done' if the item's commit with the greatest token is of this very version, 'leased'
    if an unexpired lease of this version is out, else 'pending'. Null versions equal each other only.

    ``items`` has one row per item. Commits and leases are aggregated per item before the join, so neither repeated
    rows nor an item with very many of them make rows or a hot task.
    """
    last = done.groupBy("item").agg(F.max(F.struct("token", "version")).alias("_last"))
    joined = items.join(last, "item", "left")
    state = F.when(F.col("_last").isNotNull() & F.col("version").eqNullSafe(F.col("_last.version")), "done")
    drop = ["_last"]
    if leases is not None:
        out = leases.groupBy("item").agg(F.max(F.struct("token", "version", "expires_at")).alias("_lease"))
        joined = joined.join(out, "item", "left")
        held = F.col("_lease").isNotNull() & F.col("version").eqNullSafe(F.col("_lease.version")) & (F.col("_lease.expires_at") > now)
        state = state.when(held, "leased")
        drop.append("_lease")
    return joined.withColumn("state", state.otherwise("pending")).drop(*drop)


def page_states(store: DataFrame, processed: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(item, rec_id, version, state): the newest state of every page by the ledger into which the recorded runs were taken.

    The ledger lies at ``path``, or at a new place in the shared folder. Taking the same runs in again changes nothing.
    """
    ledger = WorkLedger(store.sparkSession, path or stage_path(store.sparkSession, "ledger"))
    ledger.replay(run_events(processed, runs))
    return ledger.states(newest_states(store))


class StaleToken(RuntimeError):
    """A commit whose token is no longer the greatest of one of its items, or is over since a compaction."""


class WorkLedger:
    """A ledger kept as files under ``path``, which must be reachable by all executors.

    ``leases/token=N`` and ``done/token=N`` hold what a token leased and committed, ``base/N`` what a compaction
    has folded. ``lease`` may be called by any number of workers; a token is claimed by the atomic creation of its marker
    file, so no two leases share one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._folder(name)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _generation(self) -> int:
        """The newest compaction that is complete; 0 before the first."""
        return max((int(n) for n in self._names("generations")), default=0)

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = []
        generation = self._generation()
        for folder in (kind, f"base/{generation}/{kind}"):
            try:
                parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}"))
            except AnalysisException:  # nothing written yet
                continue
        if not parts:
            return self.spark.createDataFrame([], schema)
        columns = [c.split()[0] for c in schema.split(", ")]
        return parts[0].select(*columns) if len(parts) == 1 else parts[0].select(*columns).unionByName(parts[1].select(*columns))

    def _claim(self) -> int:
        fs, root = self._folder("tokens")
        fs.mkdirs(root)
        token = 1 + max(map(int, self._names("tokens")), default=0)
        while not fs.createNewFile(self._folder(f"tokens/{token}")[1]):
            token += 1
        return token

    def leases(self) -> DataFrame:
        return self._read("leases", _LEASE)

    def done(self) -> DataFrame:
        """All commits; of an item's the one with the greatest token counts."""
        return self._read("done", _DONE)

    def states(self, items: DataFrame, now: Column | None = None) -> DataFrame:
        return with_states(items, self.done(), self.leases(), F.current_timestamp() if now is None else now)

    def replay(self, events: DataFrame) -> None:
        """Takes in leases and commits made elsewhere (see ``run_events``), one folder for each token; tokens that are
        taken in again replace themselves, and later leases get greater ones."""
        columns = ["item", "version", "worker", "expires_at", "token"]
        for kind, rows in (("leases", events.select(*columns)), ("done", events.where("committed").select("item", "version", "token"))):
            # tokens of any size are spread over tasks of bounded size
            rows.hint("rebalance", "token").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("token").parquet(f"{self.path}/{kind}")
        top = max((int(n[6:]) for n in self._names("leases") if n.startswith("token=") and n[6:].lstrip("-").isdigit()), default=0)
        fs, root = self._folder("tokens")
        fs.mkdirs(root)
        fs.createNewFile(self._folder(f"tokens/{max(top, 0)}")[1])

    def lease(self, items: DataFrame, worker: str, ttl_s: int, limit: int | None = None, now: Column | None = None) -> tuple[int, DataFrame]:
        """Leases pending items (all, or ``limit`` of them in order of item) and returns the token and the leased rows."""
        now = F.current_timestamp() if now is None else now
        pending = self.states(items, now).where("state = 'pending'").select("item", "version")
        if limit is not None:
            pending = pending.orderBy("item").limit(limit)
        token = self._claim()
        out = f"{self.path}/leases/token={token}"
        pending.select("item", "version", F.lit(worker).alias("worker"), (now + F.make_dt_interval(secs=F.lit(ttl_s))).alias("expires_at")).write.mode("overwrite").parquet(out)
        mine = self._of(token)
        # of two leases taken at once the greater token holds
        top = self.leases().groupBy("item").agg(F.max("token").alias("top"))
        return token, mine.join(top, "item").where("token = top").drop("top")

    def _of(self, token: int) -> DataFrame:
        return self.spark.read.schema("item string, version string, worker string, expires_at timestamp").parquet(f"{self.path}/leases/token={token}").withColumn("token", F.lit(token).cast("bigint"))

    def commit(self, token: int) -> None:
        """Marks the items of a lease as done. Repeating it changes nothing; a stale token is refused."""
        if f"token={token}" not in self._names("leases"):
            raise StaleToken(f"token {token} is over")
        mine = self._of(token)
        later = self.leases().where(F.col("token") > token).select("item").distinct()
        if not mine.join(later, "item", "left_semi").isEmpty():
            raise StaleToken(f"token {token} was overtaken")
        mine.select("item", "version").write.mode("overwrite").parquet(f"{self.path}/done/token={token}")

    def compact(self, now: Column | None = None) -> int:
        """Folds tokens that are committed or expired into one row per item, and returns how many tokens were folded.

        What is folded is written, marked complete and only then deleted; a failure in between leaves every row readable. An
        expired token that is folded can no longer be committed.
        """
        now = F.current_timestamp() if now is None else now
        tokens = [n for n in self._names("leases") if n.startswith("token=")]
        committed = {n for n in self._names("done") if "_SUCCESS" in self._names(f"done/{n}")} | ({n for n in self._names("done") if n.startswith("token=")} if "_SUCCESS" in self._names("done") else set())
        running = {f"token={r[0]}" for r in self._read("leases", _LEASE).groupBy("token").agg(F.max("expires_at").alias("e")).where(F.col("e") > now).collect()}  # one row per token
        fold = [n for n in tokens if n in committed or n not in running]
        if not fold:
            return 0
        generation = self._generation()
        base = f"{self.path}/base/{generation + 1}"
        numbers = [int(n[6:]) for n in fold]
        for kind, schema, keep in (("leases", _LEASE, ["version", "worker", "expires_at"]), ("done", _DONE, ["version"])):
            rows = self._read(kind, schema)
            folded = rows.where(F.col("token").isin(numbers) | F.lit(False))
            if generation:
                folded = folded.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/base/{generation}/{kind}"))
            last = folded.groupBy("item").agg(F.max(F.struct("token", *keep)).alias("l"))
            last.select("item", "l.*").select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").parquet(f"{base}/{kind}")
        fs, root = self._folder("generations")
        fs.mkdirs(root)
        fs.createNewFile(self._folder(f"generations/{generation + 1}")[1])
        for name in fold:
            for kind in ("leases", "done"):
                fs, path = self._folder(f"{kind}/{name}")
                fs.delete(path, True)
        return len(fold)
