"""Routing files to their targets: a plan is a DataFrame; carrying it out is separate."""

from __future__ import annotations

import hashlib
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TransferConfig
from ..functions.paths import basename, stem
from .template import compile_template, settle_conflicts

PLAN = ["file_path", "target", "reason", "action"]


def transfer_plan(files: DataFrame, placed: DataFrame, cfg: TransferConfig, errors: DataFrame | None = None) -> DataFrame:
    """(file_path, target, reason, action) from files with metadata and their roles.

    Unique files and representatives go to their templated targets; duplicates to a folder named after the best file
    of their set, if there is a duplicate folder; errors to the error folder, if there is one. With
    ``reference_routing`` representatives are moved only where there is no duplicate folder.
    """
    action = F.lit("move" if cfg.move else "copy")
    named = files.join(placed.select("file_path", "set_id", "role", "rank"), "file_path")
    templated = F.col("role") == "unique"
    if not cfg.reference_routing or cfg.duplicate_dir is None:
        templated |= F.col("role") == "representative"
    main = named.where(templated).select("file_path", compile_template(cfg.template, cfg.target_dir, cfg.seed).alias("target"), F.col("role").alias("reason"))
    plan = settle_conflicts(main, cfg.seed)
    if cfg.duplicate_dir is not None:
        best = placed.where("rank = 1").select("set_id", stem(F.col("file_path")).alias("best_stem"))
        spare = placed.where("role = 'duplicate'").join(best, "set_id")
        target = F.concat_ws("/", F.lit(cfg.duplicate_dir.rstrip("/")), "best_stem", basename(F.col("file_path")))
        plan = plan.unionByName(settle_conflicts(spare.select("file_path", target.alias("target"), F.lit("duplicate").alias("reason")), cfg.seed))
    if cfg.error_dir is not None and errors is not None:
        target = F.concat_ws("/", F.lit(cfg.error_dir.rstrip("/")), basename(F.col("file_path")))
        plan = plan.unionByName(settle_conflicts(errors.select("file_path", target.alias("target"), F.lit("error").alias("reason")), cfg.seed))
    return plan.withColumn("action", action).select(*PLAN)


def anything_to_do(placed: DataFrame, cfg: TransferConfig, errors: DataFrame | None = None) -> bool:
    """Whether a transfer would touch any file."""
    wanted = ["unique"] if cfg.reference_routing else ["unique", "representative"]
    if cfg.duplicate_dir is not None:
        wanted.append("duplicate")
    if not placed.where(F.col("role").isin(wanted)).isEmpty():
        return True
    return cfg.error_dir is not None and errors is not None and not errors.isEmpty()


def free_target(source: str, target: str, attempts: int = 100) -> str | None:
    """``target``, or where another file lies there already the first free name with a suffix; None if it already holds ``source``.

    Suffixes depend on the path and the attempt alone, so that a task that is run again meets its own earlier work: a
    copy of the same size and time.
    """
    stat = os.stat(source) if os.path.exists(source) else None
    head, ext = os.path.splitext(target)
    for attempt in range(attempts + 1):
        name = target if attempt == 0 else f"{head}_{hashlib.md5(f'{source}|{attempt}'.encode()).hexdigest()[:8]}{ext}"
        if not os.path.exists(name):
            return name
        there = os.stat(name)
        if stat is None or (there.st_size == stat.st_size and int(there.st_mtime) == int(stat.st_mtime)):
            return None
    raise FileExistsError(f"no free name for {target} after {attempts} attempts")


def carry_out(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Copy or move the files (a shared file system is assumed); returns the plan with ``error``, targets as they became.

    A failure concerns its file only. A dry run, the default, touches nothing. A file that lies at a target already is never overwritten.
    """

    def run(batches):
        for pdf in batches:
            errors, targets = [], []
            for source, target, action in zip(pdf["file_path"], pdf["target"], pdf["action"]):
                error = None
                try:
                    if not dry_run:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        free = free_target(source, target)
                        if free is not None:
                            target = free
                            (shutil.move if action == "move" else shutil.copy2)(source, target)
                except OSError as e:
                    error = f"FileSystemError: {e}"
                errors.append(error)
                targets.append(target)
            pdf["target"], pdf["error"] = targets, errors
            yield pdf

    return plan.mapInPandas(run, "file_path string, target string, reason string, action string, error string")
