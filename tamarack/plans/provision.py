"""The whole job: profile, subset, mask, load, validate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.config import Rules
from tamarack.operators import mask as masking
from tamarack.operators import profile, subset, validate
from tamarack.sources import catalog, tables
from tamarack.sources.scratch import Scratch


@dataclass(frozen=True)
class Request:
    """What to provision. ``record_count`` bounds the anchor and unrelated tables, never the rows that follow the anchor."""

    tables: tuple[str, ...]
    scenario: str = ""
    record_count: int = 100
    max_records: int | None = None
    start: str | None = None
    end: str | None = None
    skip_profiling: bool = False
    skip_subsetting: bool = False
    skip_masking: bool = False
    skip_provisioning: bool = False
    max_hops: int = 1
    salt: str = "tamarack"
    protect_keys: bool = False
    truncate: bool = False
    keep_format: bool = False
    on_drift: str = "warn"
    request_id: str = "request"

    def __post_init__(self):
        if not self.tables:
            raise ValueError("no table is requested")
        if self.start and self.end and self.start > self.end:
            raise ValueError("the date range ends before it starts")
        if self.record_count < 1:
            raise ValueError("record_count must be positive")
        if self.max_records is not None:
            object.__setattr__(self, "record_count", min(self.record_count, self.max_records))
        if self.on_drift not in ("ignore", "warn", "stop"):
            raise ValueError("on_drift is ignore, warn or stop")
        if self.skip_subsetting and not self.skip_masking:
            raise ValueError("subsetting can be skipped only with masking")
        if self.skip_masking and not self.skip_provisioning:
            raise ValueError("masking can be skipped only with provisioning")


@dataclass
class Run:
    """Results of the steps that ran; data sets stay DataFrames. ``release`` when they are not read any more."""

    status: str = "completed"
    error: str | None = None
    classified: DataFrame | None = None
    profiles: DataFrame | None = None
    relationships: DataFrame | None = None
    subsets: dict[str, DataFrame] = field(default_factory=dict)
    how: dict[str, str] = field(default_factory=dict)
    integrity: DataFrame | None = None
    masked: dict[str, DataFrame] = field(default_factory=dict)
    masks: dict[str, dict[str, str]] = field(default_factory=dict)
    loads: DataFrame | None = None
    checks: DataFrame | None = None
    target_integrity: DataFrame | None = None
    cause: Exception | None = None
    drift: DataFrame | None = None
    extracted: DataFrame | None = None
    stats: DataFrame | None = None
    rows: dict[str, int] = field(default_factory=dict)
    held: list = field(default_factory=list)

    def release(self) -> None:
        """Lets go of what the run keeps for its own steps: cached plans, and the subsets written for a load."""
        for x in self.held:
            x.release() if isinstance(x, Scratch) else x.unpersist()
        self.held.clear()


def plan_of(classified: DataFrame, relationships: DataFrame, dfs: dict[str, DataFrame], keys: dict[str, list[str]], date_column: str | None = None) -> subset.Plan:
    """The subset plan of a profile. Only names of tables and columns reach the driver."""
    first = profile.anchor_table(profile.table_profiles(classified)).collect()
    names = {t.upper(): t for t in dfs}
    anchor = names.get(first[0].table_name.upper()) if first else None
    rows = profile.join_paths(relationships.orderBy("order_1", "order_2", "column_1", "column_2")).collect()
    links = tuple(subset.Link(names[r["from"].upper()], r["key"], names[r["to"].upper()], r["key_to"]) for r in rows if r["from"].upper() in names and r["to"].upper() in names)
    have = {t: {c.lower() for c in df.columns} for t, df in dfs.items()}
    links = tuple(x for x in links if x.col.lower() in have[x.table] and x.to_col.lower() in have[x.to_table])
    return subset.Plan(anchor, keys, links, date_column)


def drift(spark: SparkSession, classified: DataFrame, dfs: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """``profile.changes`` between a stored profile and the tables as they are now; no table is read.

    Types are compared where the profile was taken from tables; layouts and DDL name types of their own.
    """
    now = profile.classify_fields(catalog.fields_from_tables(spark, dfs, measured=False).drop("row_count"), rules)
    mine = F.col("kind") == "table"
    stored = classified.where(F.lower("table_name").isin([t.lower() for t in dfs]))
    untyped = stored.where(~mine).select(F.upper("table_name").alias("_t")).distinct()
    stored = stored.withColumn("declared_type", F.when(mine, F.col("declared_type")))
    now = now.join(F.broadcast(untyped), F.upper("table_name") == F.col("_t"), "left").withColumn("declared_type", F.when(F.col("_t").isNull(), F.col("declared_type")))
    return profile.changes(stored, now)


def run(spark: SparkSession, request: Request, dfs: dict[str, DataFrame], keys: dict[str, list[str]], target: str | tables.Target | None = None, fields: DataFrame | None = None, plan: subset.Plan | None = None, rules: Rules = Rules(), references: tuple = ()) -> Run:
    """Runs the steps that the request asks for and stops at the first that fails.

    ``fields`` is a catalog with ``table_order`` (by default that of the tables'
    own schemas), or a stored one when profiling is skipped, which is compared with the
    tables first (``on_drift``: the differences are ignored, kept in ``drift``, or stop the run); ``keys`` order each
    table's rows; ``plan`` replaces the plan that the profile gives. A failing
    profile, subset or mask makes the status failed, loads or checks that do not
    pass make it partial. ``references`` close the subsets (``closure.Reference``).
    For a load each subset is computed once: it is written below the shared folder, and
    its rows and the values to be masked are counted on the way.
    """
    out = Run()
    wanted = {t.lower() for t in request.tables}
    dfs = {t: df for t, df in dfs.items() if t.lower() in wanted}
    try:
        if not dfs:
            raise ValueError("no requested table exists")
        if request.skip_profiling and fields is None:
            raise ValueError("without profiling a stored catalog is needed")
        known = fields if fields is not None else catalog.fields_from_tables(spark, dfs)
        out.classified = profile.classify_fields(profile.filter_tables(known, list(request.tables)), rules).cache()
        out.held.append(out.classified)
        if fields is not None and request.on_drift != "ignore":
            out.drift = drift(spark, out.classified, dfs, rules)
            if request.on_drift == "stop" and not out.drift.isEmpty():
                raise ValueError("the tables differ from the stored profile: " + ", ".join(f"{r.table_name}.{r.column_name} {r.change}" for r in out.drift.orderBy("table_name", "column_name").limit(10).collect()))
        out.profiles = profile.table_profiles(out.classified)
        out.relationships = profile.infer_relationships(out.classified, rules)
        if request.skip_subsetting:
            return out
        plan = plan or plan_of(out.classified, out.relationships, dfs, keys)
        out.subsets, out.how = subset.subset(dfs, plan, request.record_count, request.start, request.end, request.max_hops, references=references)
        out.held += [df for t, df in out.subsets.items() if out.how[t] == "anchor_subset"]
        links = [x for x in plan.links if {x.table.lower(), x.to_table.lower()} <= wanted]
        load = not (request.skip_masking or request.skip_provisioning or target is None)
        if request.skip_masking:
            if links:
                out.integrity = subset.integrity_report(out.subsets, links)
            return out
        details = out.classified.where("class in ('pii', 'key', 'control')").select(F.lower("table_name").alias("t"), F.lower("name").alias("c"), "class", "pii_type", "max_length").collect()  # names only
        totals: list[tuple] = []
        scratch = Scratch(spark, "provision") if load else None
        out.held += [scratch] if load else []
        for t, df in list(out.subsets.items()):
            mine = [r for r in details if r.t == t.lower()]
            kept = tuple(r.c for r in mine if r["class"] != "pii") if request.protect_keys else ()
            out.masks[t] = masking.mask_columns(df, {r.c: r.pii_type for r in mine if r["class"] == "pii"}, kept, rules, request.keep_format)
            if load:
                df, seen = scratch.observed(df, t, rows=F.count(F.lit(1)), values=masking.filled_values(out.masks[t]))
                out.subsets[t], out.rows[t] = df, seen["rows"]
                totals.append((t, seen["rows"], seen["values"]))
            limits = {c: r.max_length for c in df.columns for r in mine if r.c == c.lower() and r.max_length} if request.truncate else None
            out.masked[t] = masking.mask(df, out.masks[t], request.salt, limits)
        if links:
            out.integrity = subset.integrity_report(out.subsets, links)
        if not load:
            return out
        out.extracted = subset.extraction_rows(spark, [(t, out.how[t], n, len(out.subsets[t].columns)) for t, n, _ in totals])
        out.stats = spark.createDataFrame([(t, len(out.masks[t]), sorted(out.masks[t]), n, values) for t, n, values in totals], masking.STATS)
    except Exception as e:
        out.status, out.error, out.cause = "failed", str(e), e
        return out
    load_and_validate(out, target, [x for x in plan.links if {x.table.lower(), x.to_table.lower()} <= wanted], rules)
    return out


def load_and_validate(out: Run, target: str | tables.Target, links: list[subset.Link] = (), rules: Rules = Rules()) -> Run:
    """Loads a run's masked tables, checks each and, over all of them, the links between loaded tables.

    Sets ``loads``, ``checks`` and ``target_integrity``; a failed load or check
    makes the status partial. Orphans are reported and fail no check, as a link
    holds in the target only where both of its columns have the same mask.
    """
    out.loads, loaded = tables.load_all(out.masked, target)
    # expected is what was extracted, actual what the target says of itself: one scan a table, a few rows each
    checks = [validate.validate_table(df, t, out.rows[t] if t in out.rows else out.masked[t].count(), out.masked[t].columns, rules) for t, df in loaded.items()]
    if checks:
        found = reduce(DataFrame.unionByName, checks)
        out.checks = found.sparkSession.createDataFrame(found.collect(), found.schema)
    here = {t.lower() for t in loaded}
    kept = [x for x in links if {x.table.lower(), x.to_table.lower()} <= here]
    out.target_integrity = subset.integrity_report(loaded, kept) if kept else None
    passed = out.checks is not None and out.checks.where("not passed").isEmpty()
    if not passed or not out.loads.where("status in ('failed', 'rolled back')").isEmpty():
        out.status = "partial"
    return out


def run_summary(spark: SparkSession, run: Run) -> DataFrame:
    """One row of the run's totals; the validation status is N/A where nothing was validated."""
    one = spark.range(1).select(F.lit(run.status).alias("status"))

    def add(df: DataFrame, part: DataFrame | None, **columns) -> DataFrame:
        if part is None:
            return df.withColumns({k: F.lit(default) for k, (_, default) in columns.items()})
        row = part.agg(*(expr.alias(k) for k, (expr, _) in columns.items())).withColumn("_one", F.lit(1))
        return df.withColumn("_one", F.lit(1)).join(row, "_one").drop("_one")

    out = add(one, run.profiles, tables_profiled=(F.count("*"), 0), total_fields=(F.coalesce(F.sum("field_count"), F.lit(0)), 0), pii_fields_detected=(F.coalesce(F.sum(F.size("pii_fields")), F.lit(0)), 0))
    out = add(out, run.relationships, relationships_found=(F.count("*"), 0))
    counts = run.extracted if run.extracted is not None else subset.extraction_summary(run.subsets, run.how) if run.subsets else None
    out = add(out, counts, rows_extracted=(F.coalesce(F.sum("row_count"), F.lit(0)), 0))
    stats = run.stats if run.stats is not None else reduce(DataFrame.unionByName, [masking.mask_stats(run.subsets[t], run.masks[t], t) for t in run.masks]) if run.masks else None
    out = add(out, stats, values_masked=(F.coalesce(F.sum("total_values_masked"), F.lit(0)), 0))
    out = add(out, run.loads, rows_loaded=(F.coalesce(F.sum("rows_loaded"), F.lit(0)), 0))
    status = None
    if run.loads is not None:
        failed = run.loads.where("status in ('failed', 'rolled back')").count()
        status = validate.validation_rollup(run.checks, failed) if run.checks is not None else run.loads.limit(1).select(F.lit("FAILED").alias("status"))
    return add(out, status, validation_status=(F.first("status"), "N/A"))
