"""Shared helpers of the training-data operators: shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_BASE: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local master that has none."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)  # with scheme and authority, as other readers need them
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_BASE:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN_BASE[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove_local, _OWN_BASE[app])
    return _OWN_BASE[app]


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


#: What a Python worker keeps from task to task: one thing at a time, by its key.
_KEPT: dict[Any, Any] = {}


def kept_by_worker(key: Any, make: Callable[[], Any]) -> Any:
    """One value for all tasks of a stage that a Python worker runs. Workers outlive stages, so what another stage has kept goes first: the tables of several never lie side by side."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Freed memory goes back to the system: the C library keeps most of it, beside the JVM and all later stages."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """Tables of one operator call in the shared folder. Writing a table cuts lineage: a lost
    executor costs a re-read, not a recomputation. Tables stay until ``drop``, the end of a ``scope`` or the end of the driver."""

    _scopes: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_base(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._held: list[str] = []
        for opened in self._scopes:
            opened.append(self)
        atexit.register(self._quiet_drop, "")

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        self._held.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this workspace that nothing reads any more."""
        self._delete(df._tessera_path)
        self._held = [p for p in self._held if p != df._tessera_path]

    def mark(self) -> int:
        """A place in this workspace for ``drop_since``."""
        return self._n

    def drop_since(self, mark: int, *kept: DataFrame) -> None:
        """Delete the tables written since the mark that nothing reads any more, all but the ``kept`` ones, and the shuffle files of their plans."""
        stay = {df._tessera_path for df in kept}
        for path in [p for p in self._held if int(p.removeprefix(f"{self.root}/").split("-")[0]) > mark and p not in stay]:
            self._delete(path)
            self._held.remove(path)
        self.collect_shuffles()

    @classmethod
    @contextlib.contextmanager
    def scope(cls) -> Iterator[None]:
        """Workspaces that are opened within go, with all their tables, at its end."""
        opened: list[Workspace] = []
        cls._scopes.append(opened)
        try:
            yield
        finally:
            cls._scopes.remove(opened)
            for ws in opened:
                ws._quiet_drop("")
            if opened:
                opened[0].collect_shuffles()

    def collect_shuffles(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing holds any more: it does so only when the driver's heap is collected."""
        gc.collect()  # data frames in cycles hold their plans
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop(self, sub: str) -> None:
        try:
            self._delete(self.root + sub)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: At most so many bytes of lists and texts go out as a broadcast.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, rows: int, size: Column | None = None) -> DataFrame:
    """The table, as a broadcast if it has at most ``rows`` rows, and their lists (``size``: a row's bytes) at most BROADCAST_BYTES; else Spark
    joins it by a shuffle."""
    n, held = df.agg(F.count(F.lit(1)), F.sum((F.lit(0) if size is None else size).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= BROADCAST_BYTES else df


def connected_components(ws: Workspace, edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one orderable type); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set is a set of stars. Each half step is one
    pre-aggregated minimum and one equi-join; minimum and edges are written in between, so that both join sides are
    plain shuffles, which adaptive execution splits when a hub holds a large part of all edges. Built-in functions only.
    Self-loops and repeated edges do not matter; an empty input gives an empty result. At most ``few`` edges, of whole numbers, are joined on the driver, in one step.
    """
    e = ws.table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _state(e)
    if 0 < state[0] <= few:
        return ws.table(_on_driver(e), "few-nodes")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        large = _star(ws, e, both=True)
        ws.drop(e)
        e = _star(ws, large, both=False)
        ws.drop(large)
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _on_driver(e: DataFrame) -> DataFrame:
    """Components of edges that fit the driver; the rows go back as one literal, without Python in the plan."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in e.collect():
        up.setdefault(u, u)
        up.setdefault(v, v)
        u, v = top(u), top(v)
        up[max(u, v)] = min(u, v)
    rows = F.explode(F.split(F.lit(",".join(f"{x} {top(x)}" for x in up)), ",")).alias("row")
    at = F.split("row", " ")
    kind = e.schema["u"].dataType
    return e.sparkSession.range(1).select(rows).select(at[0].cast(kind).alias("node"), at[1].cast(kind).alias("root"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def _star(ws: Workspace, e: DataFrame, both: bool) -> DataFrame:
    """Edges are (u, v) with u > v. both: large-star (every neighbour), else small-star (smaller neighbours)."""
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
    least = ws.table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    if both:  # larger neighbours of u link to u's minimum
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours link to the minimum
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    out = ws.table(out.where("u <> v").distinct(), "star")
    ws.drop(least)
    return out
