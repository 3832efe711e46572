"""The whole batch path: raw sets to silver, dimensions and facts, in dependency order."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import RLock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from motorlake.plans import dimensions as dims, facts, silver
from motorlake.session import scratch_path, side_by_side
from motorlake.sources.adapters import SETS, SNAPSHOT_DATE, raw_set
from motorlake.sources.lake import remove

SILVER_BATCH = "BATCH-SILVER-1"
PROCESSED_AT = "2024-03-02 00:00:00"
LOADED_AT = "2024-03-03 00:00:00"


#: Tables kept in folders by a column that scans filter on.
FOLDERS = {"fact_telemetry": ["date_key"]}


class Step:
    """Work that stores some tables, done once, when one of them is first asked for."""

    def __init__(self, run: Callable[[], object]):
        self._run = run
        self._lock = RLock()
        self._begun = False

    def __call__(self) -> None:
        with self._lock:  # others wait until it is done; the step itself may read what it has written
            if self._begun:
                return
            self._begun = True
            try:
                self._run()
            except BaseException:
                self._begun = False
                raise


class Warehouse:
    """Tables below one folder.

    ``steps`` names the work that stores a table; it is done when the table is first read.

    A table's files are never overwritten while they may be read: additions are appended, and
    a table computed from itself is written once to a new place, and a pointer with the next
    number is added.  Pointers are only ever added, and the highest holds, so a reader always
    finds one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._places: dict[str, str] = {}
        self.steps: dict[str, Step] = {}

    def _place(self, name: str) -> str:
        if name not in self._places:
            self._places[name] = f"{self.path}/{name}"
            try:
                self._places[name] = self._newest(name)["place"]
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self._places[name]

    def _newest(self, name: str) -> Row:
        """The table's pointer with the highest number; an error where there is none."""
        pointers = self.spark.read.parquet(f"{self.path}/current/{name}")
        return pointers.agg(F.max(F.struct("number", "place")).alias("p")).first()["p"]

    def table(self, name: str) -> DataFrame:
        if name in self.steps:
            self.steps[name]()
        return self.spark.read.parquet(self._place(name))

    def need(self, *names: str) -> Warehouse:
        """Store these tables, where they are not yet, at the same time."""
        steps = {id(s): s for s in (self.steps[n] for n in names if n in self.steps)}
        side_by_side(list(steps.values()))
        return self

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """First load of a table."""
        self._put(name, df, "overwrite", self._place(name))
        return self.table(name)

    def _put(self, name: str, df: DataFrame, mode: str, place: str) -> None:
        out = df.write.mode(mode).option("compression", "zstd")
        (out.partitionBy(*FOLDERS[name]) if name in FOLDERS else out).parquet(place)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows; what is there is not touched."""
        self._put(name, df, "append", self._place(name))
        return self.table(name)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """New contents, possibly computed from the old."""
        place = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        self._put(name, df, "error", place)
        try:
            number = self._newest(name)["number"] + 1
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            number = 1
        pointer = self.spark.createDataFrame([(number, place)], "number long, place string")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/current/{name}")
        self._places[name] = place
        return self.table(name)


def silver_table(spark: SparkSession, sf_dir: str, name: str, snapshot_date: str = SNAPSHOT_DATE) -> DataFrame:
    """Lazy clean rows of one set."""
    tagged = silver.tag_rows(raw_set(spark, sf_dir, name), name, snapshot_date, ["_source_file", "_row_uid"])
    return silver.clean_rows(tagged, name, SILVER_BATCH, PROCESSED_AT)


class SilverTables:
    """Stored clean rows by set name."""

    def __init__(self, w: Warehouse):
        self._w = w

    def __getitem__(self, name: str) -> DataFrame:
        return self._w.table(f"silver/{name}")


def load_set(w: Warehouse, source: Callable[[str], DataFrame], n: str, snapshot_date: str = SNAPSHOT_DATE, again: bool = False) -> None:
    """Store one set.

    bronze/<set> has every input row, raw values verbatim, with the rule that rejects it; silver/<set> and
    quarantine/<set> are its two parts.  The input is derived once, into a folder of its own that goes when
    bronze is there.  Each write counts its rows as they pass, and input must be clean plus rejected.
    With ``again`` the tables are replaced by those of a later load.
    """
    counts: dict[str, int] = {}

    def store(layer: str, rows: DataFrame, put: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        seen = Observation()
        stored = put(f"{layer}/{n}", rows.observe(seen, F.count(F.lit(1)).alias("n")))
        counts[layer] = seen.get.get("n", 0)
        return stored

    put = w.replace if again else w.write
    landed = store("landed", source(n), w.write)
    tagged = store("bronze", silver.tag_rows(landed, n, snapshot_date, ["_source_file", "_row_uid"]), put)
    remove(w.spark, f"{w.path}/landed/{n}")
    store("silver", silver.clean_rows(tagged, n, SILVER_BATCH, PROCESSED_AT), put)
    store("quarantine", silver.quarantine_rows(tagged, PROCESSED_AT), put)
    silver.assert_conserved(counts["landed"], counts["silver"], counts["quarantine"], n)


def load_silver(w: Warehouse, source: Callable[[str], DataFrame], snapshot_date: str = SNAPSHOT_DATE, again: bool = False) -> SilverTables:
    """Store all ten sets; the sets do not depend on each other."""
    side_by_side([lambda n=n: load_set(w, source, n, snapshot_date, again) for n in SETS])
    return SilverTables(w)


def silver_tables(spark: SparkSession, sf_dir: str) -> SilverTables:
    return SilverTables(open_warehouse(spark, sf_dir))


Tables = Callable[[str], DataFrame]


def _vehicles(clean: SilverTables, t: Tables) -> DataFrame:
    return dims.dim_vehicle(clean["vehicles"], clean["vehicle_customer_map"], t("dim_model"), t("dim_dealer"), t("dim_customer"))


#: What each dimension is made of (silver sets and other tables), and how; later ones read earlier ones.
DIMENSIONS: dict[str, tuple[list[str], Callable[[SparkSession, SilverTables, Tables], DataFrame]]] = {
    "dim_date": ([], lambda spark, clean, t: dims.dim_date(spark)),
    "dim_model": (["silver/vehicles"], lambda spark, clean, t: dims.dim_model(clean["vehicles"])),
    "dim_dealer": (["silver/dealers"], lambda spark, clean, t: dims.dim_dealer(clean["dealers"])),
    "dim_customer": (["silver/customers"], lambda spark, clean, t: dims.dim_customer(clean["customers"])),
    "dim_component": (["silver/components"], lambda spark, clean, t: dims.dim_component(clean["components"])),
    "part_lookup": (["silver/components", "dim_component"], lambda spark, clean, t: dims.part_lookup(clean["components"], t("dim_component"))),
    "dim_vehicle": (["silver/vehicles", "silver/vehicle_customer_map", "dim_model", "dim_dealer", "dim_customer"], lambda spark, clean, t: _vehicles(clean, t)),
}

#: The same for the facts and the bridge.
FACTS: dict[str, tuple[list[str], Callable[[SilverTables, Tables], DataFrame]]] = {
    "fact_telemetry": (["silver/telemetry", "dim_vehicle"], lambda clean, t: facts.resolve_telemetry(clean["telemetry"], t("dim_vehicle"))),
    "fact_service": (["silver/service", "dim_vehicle", "dim_dealer"], lambda clean, t: facts.resolve_service(clean["service"], t("dim_vehicle"), t("dim_dealer"))),
    "fact_warranty": (["silver/warranty", "dim_vehicle", "dim_component"], lambda clean, t: facts.resolve_warranty(clean["warranty"], t("dim_vehicle"), t("dim_component"))),
    "fact_parts": (["silver/parts", "part_lookup", "dim_dealer"], lambda clean, t: facts.resolve_parts(clean["parts"], t("part_lookup"), t("dim_dealer"))),
    "silver_diagnostics": (["silver/diagnostics"], lambda clean, t: facts.diagnostics_bridge(clean["diagnostics"], LOADED_AT)),
}


def load_dimension(w: Warehouse, clean: SilverTables, name: str) -> None:
    w.write(name, DIMENSIONS[name][1](w.spark, clean, w.table))


def load_dimensions(w: Warehouse, clean: SilverTables) -> None:
    names = list(DIMENSIONS)
    for some in (names[:5], names[5:]):
        side_by_side([lambda n=n: load_dimension(w, clean, n) for n in some])


def load_fact(w: Warehouse, clean: SilverTables, name: str, t: Tables | None = None) -> None:
    """First load of a fact or the bridge; ``t`` gives the dimensions, if not as they are now."""
    rows = FACTS[name][1](clean, t or w.table)
    if name in facts.FACT_IDS:
        rows = facts.by_time(rows) if name == "fact_telemetry" else facts.one_per_key(rows, name)
        rows = facts.number_rows(rows, name).withColumn("_loaded_at", F.lit(LOADED_AT))
    w.write(name, rows)


def load_facts(w: Warehouse, clean: SilverTables) -> None:
    side_by_side([lambda n=n: load_fact(w, clean, n) for n in FACTS])


def reload_dimensions(w: Warehouse, clean: SilverTables) -> None:
    """Another load of every dimension: old members keep their keys, new ones get the next numbers."""

    def renew(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
        old = w.table(name)
        w.replace(name, dims.renewed(old, build(old), name))

    side_by_side(
        [
            lambda: renew("dim_model", lambda old: dims.dim_model(clean["vehicles"], old)),
            lambda: renew("dim_dealer", lambda old: dims.dim_dealer(clean["dealers"], old)),
            lambda: renew("dim_customer", lambda old: dims.dim_customer(clean["customers"], old)),
            lambda: renew("dim_component", lambda old: dims.dim_component(clean["components"], old)),
            lambda: w.replace("dim_date", dims.insert_absent(w.table("dim_date"), dims.dim_date(w.spark), ["date_key"])),
        ]
    )
    parts = dims.part_lookup(clean["components"], w.table("dim_component"))
    models, dealers, customers = (w.table(f"dim_{x}") for x in ("model", "dealer", "customer"))
    side_by_side(
        [
            lambda: w.replace("part_lookup", dims.upsert(w.table("part_lookup"), parts, ["part_id"])),
            lambda: renew("dim_vehicle", lambda old: dims.dim_vehicle(clean["vehicles"], clean["vehicle_customer_map"], models, dealers, customers, old)),
        ]
    )


def reload_fact(w: Warehouse, clean: SilverTables, name: str) -> None:
    """Load the same or newer silver again: nothing is counted twice, and keys resolve against the dimensions as they are now."""
    held, fresh = w.table(name), FACTS[name][1](clean, w.table)
    if name == "fact_telemetry":
        fresh = facts.by_time(facts.new_telemetry(fresh, held))
        top = held.agg(F.coalesce(F.max("telemetry_fact_id"), F.lit(0)).alias("m")).first()["m"]
        added = facts.number_rows(fresh, name, top).withColumn("_loaded_at", F.lit(LOADED_AT))
        w.append(name, added.select(*held.columns))
    else:
        w.replace(name, facts.merge_fact(held, fresh, name) if name in facts.FACT_IDS else facts.merge_bridge(held, fresh))


def reload_facts(w: Warehouse, clean: SilverTables) -> None:
    for name in FACTS:
        reload_fact(w, clean, name)


def load_again(w: Warehouse, source: Callable[[str], DataFrame], snapshot_date: str = SNAPSHOT_DATE) -> SilverTables:
    """A whole later load: silver and quarantine, dimensions, facts and the bridge."""
    clean = load_silver(w, source, snapshot_date, again=True)
    reload_dimensions(w, clean)
    reload_facts(w, clean)
    return clean


TABLES = [
    "dim_date", "dim_model", "dim_dealer", "dim_customer", "dim_component", "dim_vehicle",
    "fact_telemetry", "fact_service", "fact_warranty", "fact_parts", "silver_diagnostics",
]


def row_counts(w: Warehouse) -> DataFrame:
    """Rows per table, in one job."""
    w.need(*TABLES)
    counts = [
        w.table(t).select(F.lit(t).alias("table_name"), F.lit(1).alias("one")) for t in TABLES
    ]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionAll(c)
    return every.groupBy("table_name").agg(F.sum("one").alias("rows"))


_open: dict[tuple[str, str], Warehouse] = {}


def on_demand(w: Warehouse, source: Callable[[str], DataFrame]) -> None:
    """Let the tables of ``w`` be stored when they are first read, each after those it is made of."""
    clean = SilverTables(w)
    for n in SETS:
        step = Step(lambda n=n: load_set(w, source, n))
        w.steps |= {f"{layer}/{n}": step for layer in ("bronze", "silver", "quarantine")}
    for n, (parts, _) in DIMENSIONS.items():
        w.steps[n] = Step(lambda n=n, parts=parts: load_dimension(w.need(*parts), clean, n))
    for n, (parts, _) in FACTS.items():
        w.steps[n] = Step(lambda n=n, parts=parts: load_fact(w.need(*parts), clean, n))


def open_warehouse(spark: SparkSession, sf_dir: str, *names: str) -> Warehouse:
    """The warehouse of one set of given tables, one for an application.

    A table is loaded, whole, when a query first asks for it; ``names`` are loaded at once.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _open:
        w = Warehouse(spark, scratch_path(spark, "warehouse"))
        on_demand(w, lambda n: raw_set(spark, sf_dir, n))
        _open[key] = w
    return _open[key].need(*names)
