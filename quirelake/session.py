"""Session set-up and the places where long plans are cut."""

from __future__ import annotations

import atexit
import contextvars
import functools
import shutil
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import Broadcast, SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quirelake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without: it gets a temporary one, gone when Python ends."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


class _Run:
    """What the running query keeps, and what it has made once already."""

    def __init__(self) -> None:
        self.kept: list[DataFrame] = []
        self.made: dict = {}


_run: contextvars.ContextVar[_Run | None] = contextvars.ContextVar("run", default=None)


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for a second read; what is lost with an executor is computed again. It lives as long as the running query's result."""
    df = df.persist(StorageLevel.DISK_ONLY)
    own = _run.get()
    if own is not None:
        own.kept.append(df)
    return df


def sent(sc: SparkContext, value: object) -> Broadcast:
    """``value`` broadcast; the driver's Python doesn't hold it any longer, as it would for as long as the query's plans."""
    out = sc.broadcast(value)
    vars(out).pop("_value", None)  # read again from its file if the driver asks
    return out


def once(name: tuple, make: Callable[[], DataFrame], kept: bool = True) -> DataFrame:
    """``make()``, ``kept``; made once in a running query however often it is asked for."""
    own = _run.get()
    if own is None:
        return make()
    if name not in own.made:
        own.made[name] = keep(make()) if kept else make()
    return own.made[name]


def _free(kept: list[DataFrame]) -> None:
    while kept:
        df = kept.pop()
        try:
            if df.sparkSession.sparkContext._jsc is not None:
                df.unpersist()
        except Exception:  # noqa: BLE001 - the session has ended, and what it kept with it
            return


def on_its_own(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query ``f``; what it keeps is freed when its result is dropped. Frames derived from the result stay right: they compute again what they need."""

    @functools.wraps(f)
    def run(spark: SparkSession, folder: str, *args) -> DataFrame:
        own = _Run()
        token = _run.set(own)
        try:
            out = f(spark, folder, *args)
        finally:
            _run.reset(token)
        weakref.finalize(out, _free, own.kept).atexit = False
        return out

    return run


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="quirelake-code-")) / "quirelake_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
