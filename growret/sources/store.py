"""Shared, stored model tables per (application, data folder).

The reference caches each query result for an hour.  Here the shared inputs
-- the model tables, and intermediate results several queries start from,
such as the event study the stage statistics read -- are written once as
parquet to the session's shared checkpoint folder, and every query reads
them.  A registered query stores the tables that it reads, and the cells of all
lines when it reads any: loads, which have cells of their own, store none.  That cuts lineage (a lost executor re-reads files instead of redoing
the lineitem aggregation) and gives one layout to all: annual bars by
``year``, monthly rows by ``report_month``, weekly bars clustered by date,
with the columns that every reader would compute again (entity key, previous
prices).  Stored tables expire after ``spark.growret.cacheSeconds`` (3600, the
reference's hour), and at once when an input file is added, removed or written
again; :func:`refresh` drops them whatever their age.  Results of a query are
kept by name and arguments beside the tables they come from.

Folders of replaced tables are removed when no reader can be expected any more,
``spark.growret.keepSeconds`` (3600) after they were replaced, at the next look
at the cache; :func:`forget` removes all folders of a session at once.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.functions.returns import entity_key, with_previous
from growret.session import ensure_checkpoint_dir
from growret.sources.fixtures import derive_model_tables, line_cells, name_ranks, read_star

_LOCK = threading.Lock()
_CACHE: dict[tuple, "ModelTables"] = {}
CACHE_SECONDS_CONF = "spark.growret.cacheSeconds"
CACHE_SECONDS = 3600
KEEP_SECONDS_CONF = "spark.growret.keepSeconds"
KEEP_SECONDS = 3600
INPUTS = ("lineitem", "part", "supplier")
#: Replaced tables by application: when, and the folder.
_RETIRED: dict[str, list[tuple[float, str]]] = {}

# Stored layout: folder columns, then the columns rows are range-clustered by.
# Range partitioning on (folder column, entity) before the write gives each
# task a contiguous slice, so a folder is written by few tasks and the file
# count stays near the task count (not tasks x folders); a folder holding a
# third of the rows is still split by the sampled range bounds.  Weekly bars
# are clustered by date, so the event-window date filter skips row groups.
_LAYOUT = {
    "stock_annual_k": (["year"], ["symbol"]),
    "monthly_revenue": (["report_month"], ["stock_id"]),
    "stock_weekly_k": ([], ["date", "symbol"]),
}
#: The tables by name, with those that are views of the cells.
NAMES = (*_LAYOUT, "stock_prices", "price_days")
#: Columns stored beside the declared ones, computed once instead of at each read.
_PREPARE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stock_annual_k": lambda df: df.withColumn("stock_id", entity_key("symbol")),
    "stock_weekly_k": with_previous,
}


class ModelTables(Mapping):
    """The model tables by name, plus shared intermediates built from them.

    ``derive()`` gives the tables to store and the views.  It is called, and a
    table stored, when the first one or that table is first asked for.
    ``shared(name, build, **arguments)`` stores ``build(self, **arguments)``
    once for each name and set of arguments, the same way as the tables.
    """

    def __init__(self, spark: SparkSession, derive: Callable[[], dict[str, DataFrame]], root: str, inputs: str = "", sf_dir: str = ""):
        self.spark = spark
        self._derive, self._derived = derive, None
        self._tables: dict[str, DataFrame] = {}
        self._storing = threading.Lock()
        self.root = root
        self.inputs = inputs  # fingerprint of the files the tables come from
        self.sf_dir = sf_dir
        self.stored_at = time.time()
        self.seconds: dict[str, float] = {}
        self._shared: dict[str, DataFrame] = {}
        self._lock = threading.Lock()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise KeyError(name)
        with self._storing:
            if self._derived is None:
                self._derived = self._derive()
            if name not in self._tables:
                df = self._derived[name]
                self._tables[name] = store_model_tables({name: df}, self.root, self.seconds)[name] if name in _LAYOUT else df
            return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)

    def shared(self, name: str, build: Callable[..., DataFrame], **arguments) -> DataFrame:
        if arguments:
            name += "-" + hashlib.sha256(repr(sorted(arguments.items())).encode()).hexdigest()[:32]
        with self._lock:
            if name not in self._shared:
                began = time.perf_counter()
                self._shared[name] = _store(build(self, **arguments), f"{self.root}/shared/{name}")
                self.seconds[f"shared {name}"] = time.perf_counter() - began
            return self._shared[name]


def shared(tables: Mapping[str, DataFrame], name: str, build: Callable[..., DataFrame], **arguments) -> DataFrame:
    """``tables.shared(name, build, **arguments)`` for stored tables; plain dicts
    (tables a caller loaded itself) just build."""
    if isinstance(tables, ModelTables):
        return tables.shared(name, build, **arguments)
    return build(tables, **arguments)


def _store(df: DataFrame, path: str, folders: list[str] = [], cluster: list[str] = []) -> DataFrame:  # noqa: B006
    if folders or cluster:
        # no explicit count: AQE sizes the write tasks from the data
        df = df.repartitionByRange(*folders, *cluster)
    w = df.write.mode("overwrite")
    (w.partitionBy(*folders) if folders else w).parquet(path)
    # explicit schema: partition folders must not be re-typed by inference
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def store_model_tables(tables: dict[str, DataFrame], path: str, seconds: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Write model tables to ``{path}/{name}`` in the stored layout and read them back."""
    out = {}
    for name, df in tables.items():
        began = time.perf_counter()
        out[name] = _store(_PREPARE.get(name, lambda x: x)(df), f"{path}/{name}", *_LAYOUT.get(name, ([], [])))
        if seconds is not None:
            seconds[name] = time.perf_counter() - began
    return out


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, lengths and times of the input files, as one hash; a listing, no file is read."""
    found = []
    for name in INPUTS:
        fs, at = _file_system(spark, f"{sf_dir}/{name}.parquet")
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def _remove(spark: SparkSession, root: str) -> None:
    fs, at = _file_system(spark, root)
    fs.delete(at, True)


def _retire(spark: SparkSession, tables: ModelTables) -> None:
    _RETIRED.setdefault(spark.sparkContext.applicationId, []).append((time.time(), tables.root))


def _remove_retired(spark: SparkSession) -> None:
    """Remove this application's folders that were replaced long enough ago."""
    keep = float(spark.conf.get(KEEP_SECONDS_CONF, str(KEEP_SECONDS)))
    mine = _RETIRED.get(spark.sparkContext.applicationId, [])
    for entry in [x for x in mine if time.time() - x[0] > keep]:
        mine.remove(entry)
        _remove(spark, entry[1])


def model_tables(spark: SparkSession, sf_dir: str, now: tuple[str, ...] = ("stock_annual_k", "monthly_revenue")) -> ModelTables:
    """Derived model tables for ``sf_dir``, stored once per application until they expire or their input changes.

    Those of ``now`` are stored at once, others when they are first asked for."""
    key = _key(spark, sf_dir)
    age = float(spark.conf.get(CACHE_SECONDS_CONF, str(CACHE_SECONDS)))
    with _LOCK:
        _remove_retired(spark)
        hit, inputs = _CACHE.get(key), fingerprint(spark, sf_dir)
        if hit is None or time.time() - hit.stored_at > age or hit.inputs != inputs:
            new = _new_tables(spark, sf_dir, inputs)
            if hit is not None:
                _retire(spark, hit)
            hit = _CACHE[key] = new
        for name in now:
            hit[name]
        return hit


def _new_tables(spark: SparkSession, sf_dir: str, inputs: str) -> ModelTables:
    # a folder of its own: neither another application nor a reader of expired tables is overwritten
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/growret-model-{uuid.uuid4().hex}"
    star = read_star(spark, sf_dir)

    def derive() -> dict[str, DataFrame]:
        def timed(name: str, df: DataFrame) -> DataFrame:
            began = time.perf_counter()
            out = _store(df, f"{root}/{name}")
            tables.seconds[name] = time.perf_counter() - began
            return out

        ranks = timed("name_ranks", name_ranks(star["part"]))
        cells = timed("cells", line_cells(star["lineitem"], ranks))
        supplier = timed("supplier", star["supplier"])  # from here on no input file is read: all tables are of one state
        # stock_prices is as large as lineitem and read for one maximum: a view of the
        # cells, whose row per entity and day has the same latest date
        return derive_model_tables(cells, supplier, ranks) | {"price_days": cells.select(F.col("d").alias("date"))}

    tables = ModelTables(spark, derive, root, inputs, sf_dir)
    return tables


def refresh(spark: SparkSession, sf_dir: str) -> ModelTables:
    """Store the model tables of ``sf_dir`` anew, whatever their age."""
    with _LOCK:
        old = _CACHE.pop(_key(spark, sf_dir), None)
        if old is not None:
            _retire(spark, old)
    return model_tables(spark, sf_dir)


def forget(spark: SparkSession) -> None:
    """Drop the remembered tables of this session's application and remove their folders, replaced ones included."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        for k in [k for k in _CACHE if k[0] == app]:
            _retire(spark, _CACHE.pop(k))
        for _, root in _RETIRED.pop(app, []):
            _remove(spark, root)
