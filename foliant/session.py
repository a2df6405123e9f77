"""Making this package known to the executors' Python."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent


def ship_code(spark: SparkSession) -> None:
    """Sends the package to the executors, unless they find it anyway: through PYTHONPATH, --py-files or the working folder."""
    context = spark.sparkContext
    seen = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = context.master.startswith("local[") and pathlib.Path.cwd().resolve() == ROOT
    if here or not ROOT.is_dir() or any(pathlib.Path(p).resolve() == ROOT for p in seen) or getattr(context, "_foliant_sent", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((ROOT / "foliant").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    path = pathlib.Path(tempfile.mkdtemp(prefix="foliant-code-")) / "foliant_code.zip"  # on the driver; Spark hands it out
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._foliant_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    Only on one machine (a local master) that names none, as in tests, a temporary folder is used; elsewhere its lack is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        found = context._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
