"""The four layers and the store that keeps two of them.

``src``, unless it is columnar already, and ``analytics`` are written once as
Parquet and read back, so a later query starts from a column-pruned scan instead
of repeating joins, and its lineage is cut at files that outlive a lost executor.
``cleaned`` and ``reporting`` stay lazy. A table is written when a query first
needs it.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import tempfile
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haberdash.operators.keys import assert_keys
from haberdash.operators.numbering import sliced
from haberdash.plans import cleaned, customers, funnel, logistics, model, products, quality, reporting, sales
from haberdash.sources import files
from haberdash.sources.schemas import MODEL_KEYS, SOURCE_KEYS, SOURCE_SCHEMAS

LAYERS = ("src", "cleaned", "analytics", "reporting")

# Tables of a layer written at the same time.
WRITERS = 4
# Complete versions of a stored table that are kept.
KEPT = 2
# Stored tables are read more often than they are written, and repeat much along an order.
CODEC = "zstd"
# Raised whenever stored tables change their form or meaning.
FORMAT = 3
NO_STATE = "0"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="haberdash-")


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Per session how many are inside ``shuffles_removed``, and what was set before the first.
_removing: dict[int, tuple[int, str | None]] = {}
_removing_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each statement inside go when it ends: its result is stored.

    Several threads may be inside; the setting goes back when the last one leaves.
    """
    with _removing_lock:
        inside, before = _removing.get(id(spark), (0, spark.conf.get(_CLEAN_SHUFFLES, None)))
        _removing[id(spark)] = inside + 1, before
        spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        with _removing_lock:
            inside, before = _removing.pop(id(spark))
            if inside > 1:
                _removing[id(spark)] = inside - 1, before
            elif before is None:
                spark.conf.unset(_CLEAN_SHUFFLES)
            else:
                spark.conf.set(_CLEAN_SHUFFLES, before)


@dataclass(frozen=True)
class Held:
    """A stored table as this session reads it."""

    state: str
    epoch: int
    path: str
    frame: DataFrame


class Store:
    """Parquet tables under one root, in versions that outlive the session.

    A version is complete once it holds the writer's ``_SUCCESS`` mark, and its name says
    from which state of the input it was built. A table is read in its newest complete
    version of the wanted state, by any session on the same root; without one a new
    version is written, no other is touched, and then all but the newest ``KEPT`` complete
    ones go, so a reader of the version before is not disturbed. A catalog table that
    stands for a stored one is pointed to each new version before an old one goes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        self._written: dict[str, Held] = {}
        self._dropped: dict[str, int] = {}
        self._epoch = 0
        self._locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self._lock = threading.Lock()

    def _files(self):
        """Hadoop's file system of the root, which may be any store Spark reaches."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(context._jsc.hadoopConfiguration()), path

    def _complete(self, name: str) -> list[str]:
        """Complete versions of a table, oldest first."""
        system, path = self._files()
        folder = path(f"{self.root}/{name}")
        if not system.exists(folder):
            return []
        found = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory())
        return [v for v in found if system.exists(path(f"{self.root}/{name}/{v}/_SUCCESS"))]

    def versions(self, name: str) -> list[str]:
        """Paths of the complete versions of a table, oldest first."""
        return [f"{self.root}/{name}/{v}" for v in self._complete(name)]

    def _write(self, name: str, frame: DataFrame, state: str) -> str:
        before = self._complete(name)
        number = int(before[-1][1:9]) + 1 if before else 1
        version = f"v{number:08d}-{state or NO_STATE}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            frame.write.option("compression", CODEC).parquet(f"{self.root}/{name}/{version}")
        self._point(name, f"{self.root}/{name}/{version}")
        system, path = self._files()
        for old in self._complete(name)[:-KEPT]:
            system.delete(path(f"{self.root}/{name}/{old}"), True)
        return version

    def has(self, name: str, state: str = "") -> bool:
        """Whether the stored table ``name`` of one state of the input is complete and not dropped."""
        held, forgotten = self._known(name)
        if held is not None and held.state == state and held.epoch >= forgotten:
            return True
        stale = forgotten > (held.epoch if held else 0)
        return not stale and any(f"-{state or NO_STATE}-" in v for v in self._complete(name))

    def _known(self, name: str) -> tuple[Held | None, int]:
        """The table as this session holds it, and when it was last dropped."""
        forgotten = max((e for prefix, e in self._dropped.items() if name.startswith(prefix)), default=0)
        return self._written.get(name), forgotten

    def table(self, name: str, build: Callable[[], DataFrame], state: str = "") -> DataFrame:
        """The stored table ``name`` of one state of the input, written from ``build()`` if there is none yet.

        Different tables may be written at the same time; a second caller of the
        same one waits for the first.
        """
        with self._lock:
            one_writer = self._locks[name]
        with one_writer:
            held, forgotten = self._known(name)
            if held is None or held.state != state or held.epoch < forgotten:
                stale = forgotten > (held.epoch if held else 0)
                known = [] if stale else [v for v in self._complete(name) if f"-{state or NO_STATE}-" in v]
                version = known[-1] if known else self._write(name, build(), state)
                path = f"{self.root}/{name}/{version}"
                # Kept as a frame, so its files are listed once.
                held = Held(state, self._epoch, path, self.spark.read.parquet(path))
                self._written[name] = held
            return held.frame

    def drop(self, prefix: str) -> None:
        """Forget the tables under ``prefix``; next use writes a new version."""
        with self._lock:
            self._epoch += 1
            self._dropped[prefix] = self._epoch

    def stored(self, layer: str) -> list[str]:
        """Sorted names of the tables of ``layer`` that this session has read or written."""
        head = f"{layer}/"
        return sorted(n[len(head) :] for n in self._written if n.startswith(head))

    # -- catalog ----------------------------------------------------------------

    def _location(self, entry: str) -> str | None:
        """Where a catalog table lies, or None without one."""
        if not self.spark.catalog.tableExists(entry):
            return None
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {entry}").where("col_name = 'Location'").first()
        return described["data_type"] if described else ""

    def published(self, name: str) -> bool:
        """Whether the catalog has a table for a version of the stored table ``name``."""
        entry = catalog_entry(name)
        return bool(entry) and f"{self.root}/{name}/" in (self._location(entry) or "")

    def _point(self, name: str, path: str) -> None:
        if self.published(name):
            self.spark.sql(f"ALTER TABLE {catalog_entry(name)} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(catalog_entry(name))

    def publish(self, name: str) -> None:
        """Enter a table that this session holds in the catalog, or point its entry to the held version."""
        entry, held = catalog_entry(name), self._written[name]
        location = self._location(entry)
        if location is not None and location.rstrip("/").endswith(held.path.split("://")[-1].lstrip("/")):
            return
        if location is not None and self.spark.table(entry).schema == held.frame.schema:
            self.spark.sql(f"ALTER TABLE {entry} SET LOCATION '{held.path}'")
            self.spark.catalog.refreshTable(entry)
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {entry}")
        self.spark.catalog.createTable(entry, path=held.path, source="parquet", schema=held.frame.schema)


def catalog_entry(name: str) -> str | None:
    """The catalog table that stands for a stored one: ``…/<layer>/<relation>`` as ``<layer>.<relation>``."""
    layer, _, relation = name.rpartition("/")
    layer = layer.rpartition("/")[2]
    return f"{layer}.{relation}" if layer in LAYERS else None


def digest(*parts: object) -> str:
    return hashlib.sha1(repr(parts).encode()).hexdigest()[:16]


def own_store(spark: SparkSession, root: str | None, paths: Iterable[str]) -> Store:
    """The store of the input at ``paths``, under ``root`` or the shared folder."""
    base = root or f"{shared_folder(spark)}/haberdash"
    return Store(spark, f"{base}/format-{FORMAT}/{digest(*sorted(paths))}")


class Warehouse:
    """Relations by layer, for one import and one pair of cutoff dates.

    ``load`` maps a relation name to the raw DataFrame to import; the relations
    in ``in_place`` already lie in a columnar form and are read without a copy.
    The cutoffs leave out the last, incomplete period of orders and stock, and
    of events. ``states`` lists the state of the files behind each relation; a stored
    table belongs to the states of the relations it is made of, so files that change
    cost a new version of that relation and of what depends on it, and nothing else.
    ``reject`` maps a relation name to the rows that its import sets aside, if any may be.
    ``load_columns`` may derive some columns of a raw relation with less work than all of them.
    """

    def __init__(
        self,
        store: Store,
        load: Callable[[str], DataFrame],
        sales_cutoff: dt.date,
        event_cutoff: dt.date,
        in_place: Collection[str] = (),
        states: Callable[[], Mapping[str, str]] = dict,
        reject: Callable[[str], DataFrame] | None = None,
        load_columns: Callable[[str, Collection[str]], DataFrame] | None = None,
    ) -> None:
        self.store = store
        self.spark = store.spark
        self.sales_cutoff = sales_cutoff
        self.event_cutoff = event_cutoff
        self._load = load
        self._reject = reject
        self._load_columns = load_columns
        self._in_place = frozenset(in_place)
        self._list_states = states
        self._states = dict(states())
        self._read: dict[str, DataFrame] = {}
        self._exported: set[str] = set()
        self._exporting: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self._lock = threading.Lock()

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        folder: str,
        sales_cutoff: dt.date,
        event_cutoff: dt.date,
        root: str | None = None,
        set_aside: bool = False,
    ) -> Warehouse:
        """Import ``folder/<relation>.csv`` for each of the seven relations.

        ``root`` is where the stored layers go, by default a folder under the shared
        one. A later session on the same files and root finds them there. A row that does
        not fit ends the import or, if such rows are ``set_aside``, goes to ``rejected``;
        the two kinds of import share no stored table.
        """
        paths = {name: f"{folder}/{name}.csv" for name in SOURCE_SCHEMAS}
        return cls(
            own_store(spark, root, [*paths.values(), *(["rows set aside"] if set_aside else [])]),
            lambda name: files.read_csv(spark, name, paths[name], set_aside),
            sales_cutoff,
            event_cutoff,
            states=lambda: files.fingerprints(spark, paths),
            reject=(lambda name: files.rejected_rows(spark, name, paths[name])) if set_aside else None,
        )

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        folder: str,
        sales_cutoff: dt.date,
        event_cutoff: dt.date,
        root: str | None = None,
    ) -> Warehouse:
        """Read ``folder/<relation>.parquet`` for each of the seven relations, in place."""
        paths = {name: f"{folder}/{name}.parquet" for name in SOURCE_SCHEMAS}
        return cls(
            own_store(spark, root, paths.values()),
            lambda name: files.read_parquet(spark, name, paths[name]),
            sales_cutoff,
            event_cutoff,
            in_place=SOURCE_SCHEMAS,
            states=lambda: files.fingerprints(spark, paths),
        )

    # -- layers ---------------------------------------------------------------

    def _state(self, sources: Iterable[str]) -> str:
        """The state of the files behind some source relations."""
        known = [(name, self._states[name]) for name in sorted(set(sources)) if name in self._states]
        return digest(*known) if known else ""

    def source(self, name: str) -> DataFrame:
        if name in self._in_place:
            if name not in self._read:
                self._read[name] = self._load(name)
            return self._read[name]
        return self.store.table(f"src/{name}", lambda: self._load(name), self._state([name]))

    def source_columns(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a source relation, all rows: as stored or, while it is not, derived alone."""
        stored = name in self._in_place or self.store.has(f"src/{name}", self._state([name]))
        if stored or self._load_columns is None:
            return self.source(name).select(*columns)
        return self._load_columns(name, columns)

    def rejected(self, *names: str) -> DataFrame:
        """Rows that the import of ``names`` (by default all) set aside: relation, file, line, columns.

        Stored per relation for the state of its files, in a second pass over them.
        """
        if self._reject is None:
            raise ValueError("this import sets no rows aside")
        parts = [
            self.store.table(f"rejected/{name}", lambda name=name: self._reject(name), self._state([name]))
            for name in names or SOURCE_SCHEMAS
        ]
        return functools.reduce(DataFrame.unionByName, parts)

    def cleaned(self, name: str) -> DataFrame:
        return cleaned.VIEWS[name](self.source(name))

    def _modelled(self, name: str) -> DataFrame:
        """A cleaned relation as the model reads it."""
        if name not in model.READ:
            return self.cleaned(name)
        return cleaned.VIEWS[name](self.source_columns(name, *model.READ[name]))

    def model(self, name: str) -> DataFrame:
        needs, build = model.TABLES[name]
        return self.store.table(
            f"analytics/{name}", lambda: build(*(self._modelled(n) for n in needs)), self._state(needs)
        )

    def _has_model(self, name: str) -> bool:
        return self.store.has(f"analytics/{name}", self._state(model.TABLES[name][0]))

    def model_plan(self, name: str) -> DataFrame:
        """A model table as stored or, while it is not, its plan.

        What a working table does not read of the plan is then neither moved nor written.
        """
        needs, build = model.TABLES[name]
        if self._has_model(name):
            return self.model(name)
        return build(*(self._modelled(n) for n in needs))

    def input(self, name: str) -> DataFrame:
        """A table that reports read: of the star schema, or a working table.

        Facts that are projections of their relation are not written for it, and of the
        item fact only what reports read is.
        """
        if name == ITEM_FACT and not self._has_model(name):
            return self.working("reported_items")
        if name in model.TABLES:
            return self.model_plan(name) if name.startswith("fact_") else self.model(name)
        return self.working(name)

    def _rows_for(self, name: str, working: str) -> DataFrame:
        """A model table that a working table is made of; reported items do for the item fact."""
        if name == ITEM_FACT and working != "reported_items" and not self._has_model(name):
            needs = WORKING["reported_items"][0]
            if self.store.has(f"{self._work()}/reported_items", self._state(self._sources_of(needs))):
                return self.working("reported_items")
        return self.model_plan(name)

    def report(self, name: str) -> DataFrame:
        needs, build = reporting.VIEWS[name]
        cutoff = self.event_cutoff if name == "session_funnel" else self.sales_cutoff
        return build(*(self.input(n) for n in needs), cutoff)

    def reimported(self, name: str) -> DataFrame:
        """A source relation after a trip through CSV: exported, then imported."""
        path = f"{self.store.root}/export/{self._state([name]) or NO_STATE}/{name}.csv"
        with self._lock:
            one_writer = self._exporting[path]
        with one_writer:
            if path not in self._exported:
                files.write_csv(self.source(name), path)
                self._exported.add(path)
        return files.read_csv(self.spark, name, path)

    def all_reimported(self) -> dict[str, DataFrame]:
        """Every source relation after a trip through CSV; several are exported at the same time."""
        with ThreadPoolExecutor(WRITERS) as pool:
            return dict(zip(SOURCE_SCHEMAS, pool.map(self.reimported, SOURCE_SCHEMAS)))

    @staticmethod
    def _sources_of(tables: Iterable[str]) -> set[str]:
        """Source relations behind model and working tables."""
        models = {m for t in tables for m in (WORKING[t][0] if t in WORKING else (t,))}
        return {source for m in models for source in model.TABLES[m][0]}

    def keep(
        self, name: str, build: Callable[[], DataFrame], tables: Collection[str] = ()
    ) -> DataFrame:
        """A table made of model ``tables`` (by default all), stored until their sources change or the model is built again."""
        return self._keep(name, build, self._sources_of(tables or model.TABLES))

    def _keep(self, name: str, build: Callable[[], DataFrame], sources: Iterable[str]) -> DataFrame:
        return self.store.table(f"{self._work()}/{name}", build, self._state(sources))

    def keeper(self, *tables: str) -> Callable[[str, Callable[[], DataFrame]], DataFrame]:
        """``keep`` for what is made of ``tables``."""
        return lambda name, build: self.keep(name, build, tables)

    def working(self, name: str) -> DataFrame:
        """A working table that several reports read."""
        needs, build, dated = WORKING[name]
        cutoff = self.event_cutoff if dated == "events" else self.sales_cutoff
        return self.keep(name, lambda: build(*(self._rows_for(n, name) for n in needs), cutoff), needs)

    def _work(self) -> str:
        """Working tables depend on the cutoffs."""
        return f"work/{self.sales_cutoff}-{self.event_cutoff}"

    def session_flags(self) -> DataFrame:
        return funnel.session_flags(self.working("sessions"))

    def session_profile(self) -> DataFrame:
        """Steps and attributes of each raw session, which the session checks read."""
        return self._keep("session_profile", lambda: quality.session_profile(self.source("events")), ["events"])

    def customer_orders(self) -> DataFrame:
        return self.working("customer_orders")

    def drop_session_flags(self) -> None:
        self.store.drop(f"{self._work()}/sessions")

    # -- layer administration ---------------------------------------------------

    def relation(self, layer: str, name: str) -> DataFrame:
        readers = {
            "src": self.source,
            "cleaned": self.cleaned,
            "analytics": self.model,
            "reporting": self.report,
        }
        return readers[layer](name)

    @staticmethod
    def names(layer: str) -> list[str]:
        """Sorted relation names of a layer."""
        catalogs = {
            "src": SOURCE_SCHEMAS,
            "cleaned": cleaned.VIEWS,
            "analytics": MODEL_KEYS,
            "reporting": reporting.VIEWS,
        }
        return sorted(catalogs[layer])

    def build(self, layer: str) -> None:
        """Write every table of a stored layer that is not written yet.

        Independent tables are submitted together, so small ones fill the
        executors a large one leaves idle.
        """
        read = {"src": self.source, "analytics": self.model}[layer]
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(read, self.names(layer)))

    def assert_keys(self, layer: str) -> None:
        """Fail if a table of a stored layer has a missing or repeated primary key."""
        tables = {"src": SOURCE_KEYS, "analytics": MODEL_KEYS}[layer]
        assert_keys({name: (self.relation(layer, name), key) for name, key in tables.items()})

    def build_model(self) -> None:
        """Import the sources, write the star schema and check the primary keys of both."""
        self.build("src")
        self.assert_keys("src")
        self.build("analytics")
        self.assert_keys("analytics")

    def rebuild_model(self) -> None:
        """Drop the star schema and write it again from the cleaned layer."""
        self.store.drop("analytics/")
        self.store.drop("work/")
        self.build_model()
        self._republish()

    def update(self) -> list[str]:
        """Look at the input files again and rebuild what depends on changed ones.

        Returns the relations whose files changed. Their import, the model tables made of
        them and the catalog's tables get new versions; all others are kept.
        """
        before, self._states = self._states, dict(self._list_states())
        changed = sorted(n for n in self.names("src") if before.get(n) != self._states.get(n))
        for name in changed:
            self._read.pop(name, None)
        self.build_model()
        self._republish()
        return changed

    # -- catalog ------------------------------------------------------------------

    def create_layers(self) -> None:
        """Make one catalog database per layer, at a path under the store."""
        for layer in LAYERS:
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {layer} LOCATION '{self.store.root}/catalog/{layer}'"
            )

    def _entered(self, layer: str, name: str) -> str:
        """Store the current version of a relation; its name in the store."""
        self._stored_relation(layer, name)
        return f"{layer}/{name}" if layer in ("src", "analytics") else f"{self._work()}/{layer}/{name}"

    def _stored_relation(self, layer: str, name: str) -> DataFrame:
        if layer in ("src", "analytics"):
            return self.relation(layer, name)
        sources = [name] if layer == "cleaned" else self._sources_of(reporting.VIEWS[name][0])
        return self._keep(f"{layer}/{name}", lambda: self.relation(layer, name), sources)

    def _is_view(self, layer: str, name: str) -> bool:
        """Whether a relation is only looked at: cleaned ones, and sources that lie elsewhere."""
        return layer == "cleaned" or layer == "src" and name in self._in_place

    def register_tables(self, layers: Iterable[str] = LAYERS) -> None:
        """Enter layers in the catalog as ``<layer>.<name>``, at their current versions.

        Relations that are not stored yet, views and reports as they stand at the cutoffs,
        are written first; sources read in place are entered by ``register_views`` only.
        Later builds and updates move the entries on.
        """
        self.create_layers()
        for layer in layers:
            for name in self.names(layer):
                if not (layer == "src" and name in self._in_place):
                    self.store.publish(self._entered(layer, name))

    def _republish(self) -> None:
        """Bring catalog tables of lazy layers up to date; those of stored layers moved when written."""
        for layer in LAYERS:
            for name in self.names(layer):
                if not (layer == "src" and name in self._in_place):
                    stored = f"{self._work()}/{layer}/{name}" if layer in ("cleaned", "reporting") else f"{layer}/{name}"
                    if self.store.published(stored):
                        self.store.publish(self._entered(layer, name))

    def register_views(self, layers: Iterable[str] = LAYERS) -> None:
        """Expose layers to ``spark.sql`` as ``<layer>_<name>`` views."""
        for layer in layers:
            for name in self.names(layer):
                self.relation(layer, name).createOrReplaceTempView(f"{layer}_{name}")

    def listed(self, layer: str) -> dict[str, DataFrame]:
        """The relations that the catalog lists for a layer, after entering this warehouse's.

        Stored relations and reports are tables of the layer's database, views are views.
        """
        self.create_layers()
        for name in self.names(layer):
            if self._is_view(layer, name):
                self.relation(layer, name).createOrReplaceTempView(f"{layer}_{name}")
            else:
                self.store.publish(self._entered(layer, name))
        views = self.spark.sql(f"SHOW VIEWS LIKE '{layer}_*'").where("isTemporary")
        found = {v["viewName"].removeprefix(f"{layer}_"): v["viewName"] for v in views.collect()}
        tables = self.spark.sql(f"SHOW TABLES IN {layer}").where("NOT isTemporary")
        found |= {t["tableName"]: f"{layer}.{t['tableName']}" for t in tables.collect()}
        return {name: self.spark.table(found[name]) for name in sorted(found)}


ITEM_FACT = "fact_order_items"

# Working table -> model tables it is made of, builder (tables..., cutoff), whose cutoff.
WORKING: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], str]] = {
    # The funnel's steps by session, which seven reports read.
    "sessions": (("fact_events",), funnel.sessions, "events"),
    # What reports read of the item fact while that is not stored.
    "reported_items": ((ITEM_FACT,), sales.reported_items, "sales"),
    # Valid sales per customer and order, in slices of each customer's time.
    "customer_orders": (
        (ITEM_FACT,),
        lambda items, cutoff: sliced(sales.customer_orders(items, cutoff), *customers.ORDER_OF_PURCHASES),
        "sales",
    ),
    # What each center handled of each order.
    "center_orders": ((ITEM_FACT,), logistics.center_orders, "sales"),
    # Items of all outcomes per product.
    "product_items": ((ITEM_FACT,), products.product_items, "sales"),
}
