"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "rulescope") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without one (tests) gets a fresh local folder;
    a cluster session without one is an error, never a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        _ensure_context_dir(spark, root)
        return root
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: configure a folder on the cluster's shared file system"
            )
        root = tempfile.mkdtemp(prefix="rulescope-ckpt-")
        # spark.checkpoint.dir cannot change at run time; the context's
        # checkpoint folder is the second place this function looks.
        spark.sparkContext.setCheckpointDir(root)
    return root


def _ensure_context_dir(spark: SparkSession, root: str) -> None:
    """Register the configured folder with the context too (classic
    sessions; a remote session has no context to register it with)."""
    try:
        ctx = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        return
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(root)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/rulescope/{name}-{uuid.uuid4().hex[:12]}"


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default
