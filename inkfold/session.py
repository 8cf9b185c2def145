"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(app: str = "inkfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE and Arrow on; a cluster's own settings are kept unless given here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.chunkBase64String.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers of this application, once.

    Needed where the executors don't have it installed. The driver serves the archive to them; no folder is shared for it.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="inkfold-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{home.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
