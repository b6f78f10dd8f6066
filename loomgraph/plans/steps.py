"""Steps read from a project's files: the function that discovery finds, run where the rows are."""

from __future__ import annotations

import hashlib
import io
import os
import sys
import tempfile
import types
import zipfile
from dataclasses import dataclass
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.contracts import Module, contract, spark_type
from loomgraph.plans.compile import Step, gathered
from loomgraph.plans.graph import GraphError


@dataclass
class FromArchive:
    """A module's entry function as a function of one value.

    The project's Python files are an archive that Spark brings to each executor once; the step itself holds
    only names.  A worker reads the archive and makes the module once; imports find the project's other
    modules by their paths.
    """

    archive: str
    path: str
    function: str

    def __call__(self, value: Any) -> Any:
        made = _MADE.get((self.archive, self.path))
        if made is None:
            files = _texts(self.archive)
            finder = _Project(files)
            sys.meta_path.insert(0, finder)
            try:
                made = types.ModuleType(self.path.removesuffix(".py").replace("/", "."))
                exec(compile(files[self.path], self.path, "exec"), made.__dict__)  # noqa: S102  the project's own step
            finally:
                sys.meta_path.remove(finder)
            _MADE[self.archive, self.path] = made
        return getattr(made, self.function)(value)


def _texts(archive: str) -> dict[str, str]:
    if archive not in _READ:
        with zipfile.ZipFile(SparkFiles.get(archive)) as packed:
            _READ[archive] = {name: packed.read(name).decode() for name in packed.namelist()}
    return _READ[archive]


_READ: dict[str, dict[str, str]] = {}
_MADE: dict[tuple[str, str], types.ModuleType] = {}


def archived(spark: SparkSession, texts: dict[str, str]) -> str:
    """The name under which executors find the texts; equal projects have one archive."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(texts):
            out.writestr(zipfile.ZipInfo(path), texts[path])
    name = f"project-{hashlib.sha256(packed.getvalue()).hexdigest()[:24]}.zip"
    if name not in _SENT.setdefault(spark.sparkContext.applicationId, set()):
        folder = tempfile.mkdtemp(prefix="loomgraph-steps-")  # of the driver, which serves the file to executors
        at = os.path.join(folder, name)
        with open(at, "wb") as file:
            file.write(packed.getvalue())
        spark.sparkContext.addFile(at)
        _SENT[spark.sparkContext.applicationId].add(name)
    return name


_SENT: dict[str, set[str]] = {}


class _Project:
    """Finds modules among texts; directories are packages."""

    def __init__(self, files: dict[str, str]) -> None:
        self.files = files

    def find_spec(self, name: str, path: object = None, target: object = None) -> Any:
        from importlib.machinery import ModuleSpec

        at = name.replace(".", "/")
        if f"{at}.py" in self.files:
            return ModuleSpec(name, self, origin=f"{at}.py")
        if any(p.startswith(f"{at}/") for p in self.files):
            return ModuleSpec(name, self, origin=f"{at}/__init__.py", is_package=True)
        return None

    def create_module(self, spec: Any) -> None:
        return None

    def exec_module(self, module: types.ModuleType) -> None:
        exec(compile(self.files.get(module.__spec__.origin, ""), module.__spec__.origin, "exec"), module.__dict__)  # noqa: S102


def load_steps(files: DataFrame, entrypoints: list[str], most_bytes: int = 16 << 20) -> dict[str, Step]:
    """files (path, content) to steps by entrypoint, `path` or `path:function`; a step returns what its contract says.

    A project's Python files go to the executors as one archive; their total is bounded by most_bytes.
    """
    code = files.where(F.col("path").endswith(".py")).select("path", "content")
    size = code.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise GraphError(f"the project has {size} bytes of Python, over {most_bytes}")
    texts = {r.path: r.content for r in code.collect()}
    archive = archived(files.sparkSession, texts)
    steps = {}
    for entrypoint in entrypoints:
        path, _, name = entrypoint.partition(":")
        if path not in texts:
            raise GraphError(f"there is no file {path} for a step")
        found = contract(texts[path], name or None)
        entry = Module.read(texts[path]).entry(name or None).name
        returns = spark_type(found["output"]["schema"])
        run = FromArchive(archive, path, entry)
        how = {"batch": gathered(run)} if found["isAsync"] else {"function": run}
        steps[entrypoint] = Step(**how, returns="string" if "variant" in returns or "void" in returns else returns)
    return steps
