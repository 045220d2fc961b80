"""Detection runs: all checks, what is stored of them, and when to run again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.operators.checks import REGISTRY, signed_contracts
from tenderlens.operators.scoring import all_scores, attributed
from tenderlens.operators.valuation import valued_contracts
from tenderlens.plans.staging import at_once, materialize
from tenderlens.plans.tables import Config, Tables

RERUN_AFTER = 500


def effective_config(overrides: dict | None = None) -> Config:
    """The registry's defaults with a user's sections over them; unknown names are refused."""
    o = overrides or {}
    known = {k for c in REGISTRY.values() for k in c.thresholds}
    if bad := (set(o.get("thresholds", {})) - known) | (set(o.get("weights", {})) - set(REGISTRY)):
        raise ValueError(f"unknown settings: {sorted(bad)}")
    return Config(**o)


def with_shared(t: Tables) -> Tables:
    """``t`` with the valued contracts, and those with who signed them, which many checks read, written once.  Whether a
    document comes twice is asked here, by its hash, and not in each check that counts documents."""
    t = replace(t, shared=t.shared | {"valued_contracts": materialize(valued_contracts(t), "valued")})
    document = F.xxhash64("document_number", F.coalesce("source", F.lit("comprar")))
    twice = t.shared["valued_contracts"].groupBy(document.alias("h")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return replace(t, single_documents=not twice, shared=t.shared | {"signed_contracts": materialize(signed_contracts(t), "signed")})


def run_detection(t: Tables, cfg: Config, keep: Callable[[str, DataFrame], DataFrame] = lambda key, df: df) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(findings by check, failures by check): a check that fails has no findings and stops no other.
    Checks are independent, so several are submitted at a time; ``keep`` may store the findings of one."""
    t = with_shared(t)
    keys = [key for key in REGISTRY if key not in cfg.disabled]

    def one(key: str) -> DataFrame | str:
        try:
            return keep(key, REGISTRY[key].run(t, cfg))
        except Exception as e:  # surfaced to the caller by name
            return f"{type(e).__name__}: {e}"

    got = dict(zip(keys, at_once(one, keys)))
    return {k: v for k, v in got.items() if not isinstance(v, str)}, {k: v for k, v in got.items() if isinstance(v, str)}


# ---- the ledger of runs ----------------------------------------------------------------------------------

LEDGER = "run_id string, state string, at timestamp, processes long, windowed boolean, failed array<string>, at_limit array<string>, error string"
RUNNING, DONE, PARTIAL, FAILED = "running", "done", "partial", "failed"


def _windowed(cfg: Config) -> bool:
    return cfg.date_from is not None or cfg.date_to is not None


def _enter(spark: SparkSession, root: str, row: tuple) -> DataFrame:
    """One line of the ledger, a file that appears when its job commits: a run has a line or has not."""
    line = spark.createDataFrame([row], LEDGER)
    line.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/entry={row[0]}-{row[1]}")
    return line


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The last line of each run, by the rank of its state: a run that is still ``running`` when its job is gone was lost."""
    try:
        lines = spark.read.schema(LEDGER).parquet(f"{root}/ledger/*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise
    last = F.struct((F.col("state") != RUNNING).alias("over"), *lines.columns)
    return lines.groupBy("run_id").agg(F.max_by(last, F.struct((F.col("state") != RUNNING), "at")).alias("r")).select(*(f"r.{c}" for c in lines.columns))


def persist_run(spark: SparkSession, t: Tables, cfg: Config, root: str, run_id: str, features: DataFrame | None = None) -> DataFrame:
    """Write findings (by check) and scores under a run id; returns its line in the ledger.

    A line ``running`` comes first and ``done`` last, so a job that dies half-way leaves nothing to read; one
    that ends in an error says ``failed`` and raises it.  A run some of whose checks failed says ``partial`` in place of
    ``done`` and names them with their errors; the line also names checks whose findings are as many as the limit,
    so that some may have been cut."""

    def stored(key: str, df: DataFrame) -> DataFrame:
        path = f"{root}/findings/run_id={run_id}/check_key={key}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    line = lambda state, *rest: (run_id, state, datetime.now(timezone.utc), processes, _windowed(cfg), *rest)
    processes = t.process.count()
    _enter(spark, root, line(RUNNING, [], [], None))
    try:
        saved, failed = run_detection(t, cfg, stored)
        errors = "; ".join(f"{k}: {failed[k]}" for k in sorted(failed))[:2000] or None
        if failed and not saved:
            raise RuntimeError(f"all checks failed: {errors}")
        all_scores(saved, cfg, features).write.mode("overwrite").parquet(f"{root}/scores/run_id={run_id}")
        attributed(saved).write.mode("overwrite").parquet(f"{root}/attributed/run_id={run_id}")
        full = [] if cfg.limit is None else sorted(k for k, df in saved.items() if df.count() >= cfg.limit)
    except Exception as e:
        _enter(spark, root, line(FAILED, [], [], f"{type(e).__name__}: {e}"[:2000]))
        raise
    return _enter(spark, root, line(PARTIAL if failed else DONE, sorted(failed), full, errors))


def _cached(spark: SparkSession, root: str):
    """The line of the latest run that is over, without an error of its own, and covers all dates."""
    return ledger(spark, root).filter(F.col("state").isin(DONE, PARTIAL) & ~F.col("windowed")).orderBy(F.desc("at"), F.desc("run_id")).first()


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The latest run that covers all dates; one that is ``partial`` lacks the checks that its line names."""
    row = _cached(spark, root)
    return row["run_id"] if row else None


def read_run(spark: SparkSession, root: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(attributed findings, scores) of a run."""
    return spark.read.parquet(f"{root}/attributed/run_id={run_id}"), spark.read.parquet(f"{root}/scores/run_id={run_id}")


def should_rerun(processes: int, at_last_run: int | None, cfg: Config, forced: bool = False, after: int = RERUN_AFTER) -> bool:
    """Run again if forced, never run, windowed, or with enough new processes."""
    return forced or _windowed(cfg) or at_last_run is None or processes - at_last_run >= after


def run_if_needed(spark: SparkSession, t: Tables, cfg: Config, root: str, run_id: str, forced: bool = False, after: int = RERUN_AFTER) -> tuple[str, bool]:
    """(run id, whether it was there already): the stored run that answers for the processes there are now, or a
    new one.  What counts is the number of processes in the ledger's line of the last whole run.  A run whose checks
    failed in part answers for nothing."""
    last = _cached(spark, root)
    if last and last["state"] == PARTIAL:
        last = None
    if not should_rerun(t.process.count(), last["processes"] if last else None, cfg, forced, after):
        return last["run_id"], True
    persist_run(spark, t, cfg, root, run_id)
    return run_id, False
