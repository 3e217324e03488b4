"""Makes this package importable for Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package to the session's workers once, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gaugeworks-"), "gaugeworks.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gaugeworks", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
