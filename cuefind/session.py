"""Session helpers: building a local session and finding the shared scratch folder.

On a cluster the session is created by the platform; only ``scratch_path`` is used
there, and it reads ``spark.checkpoint.dir`` from the running session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cuefind") -> SparkSession:
    """A local[N] session for tests and the bench (UI off, UTC, AQE on)."""
    # one BLAS thread per Python worker: Spark already runs one worker per core
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a local one is set where none is configured and the
    session runs on one machine. On a cluster that is an error: its files would lie on single machines."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that all executors share")
        # tests and bench on one machine
        current = tempfile.mkdtemp(prefix="cuefind-ckpt-", dir=os.environ.get("CUEFIND_SCRATCH", "/tmp"))
        spark.conf.set(_CKPT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a written intermediate table. All of an
    application's lie in one folder, see ``drop_scratch``."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cuefind/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote with ``scratch_path``: for its end, when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the session's checkpoint folder (set on demand)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` computed once and kept like ``reliable_checkpoint``, but as Parquet (columns packed and compressed): for
    large results."""
    path = scratch_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def _package_zip() -> tuple[bytes, str]:
    """The cuefind package as a deterministic zip (bytes, content hash)."""
    import hashlib
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = sorted(d for d in dirnames if d != "__pycache__")
            for name in sorted(filenames):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    info = zipfile.ZipInfo(os.path.relpath(full, root), date_time=(1980, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        zf.writestr(info, fh.read())
    data = buf.getvalue()
    return data, hashlib.sha256(data).hexdigest()[:16]


def ship_package(spark: SparkSession) -> None:
    """Make ``cuefind`` importable in the Python workers (what ``--py-files`` does): the
    package zip is written once into the shared checkpoint folder and added with
    ``addPyFile``. Idempotent per SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    data, digest = _package_zip()
    base = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{base}/cuefind-pkg/cuefind-{digest}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(str(fs.makeQualified(path).toString()))
    _SHIPPED.add(key)
