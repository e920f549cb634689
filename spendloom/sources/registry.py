"""Which logs exist, where they are and what turns them into rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import agy, claude, codex, gemini, opencode, pi
from .common import Normalised
from .landed import TableSource
from .lines import discover, read_files
from .resume import NeedsOf


@dataclass(frozen=True)
class LogSource:
    """An agent whose sessions are line-oriented logs below some roots."""

    agent: str
    roots: tuple[str, ...]
    normalise: Callable[..., Normalised]
    ext: str = ".jsonl"
    recurse: bool = True
    options: dict = field(default_factory=dict)
    #: What later lines need of earlier ones; without it a log that grew is read from its start.
    needs: NeedsOf | None = None

    def files(self, spark: SparkSession) -> DataFrame:
        return discover(spark, self.roots, self.ext, self.recurse)

    def lines(self, files: DataFrame) -> DataFrame:
        """Lines of listed ``files(path, size)``."""
        return read_files(files, self.roots, self.agent, self.ext)

    def rows(self, lines: DataFrame) -> Normalised:
        return self.normalise(lines, **self.options)


# Where each agent keeps its logs, relative to a home directory.
HOME_ROOTS = {
    "pi": [".pi/agent/sessions"],
    "claude": [".claude/projects"],
    "codex": [".codex/sessions"],
    "gemini": [".gemini"],
    "agy": [".gemini/antigravity/conversations", ".gemini/antigravity-cli/conversations"],
    "opencode": [".local/share/opencode/opencode.db"],
}

FORMATS = {"pi": pi, "claude": claude, "codex": codex, "gemini": gemini}
NORMALISERS = {agent: module.normalise for agent, module in FORMATS.items()}


def log_sources(home: str) -> list[LogSource]:
    """The four line-oriented sources below a home directory, local or on shared storage.

    The two table-backed agents are read from landed tables, see :func:`table_sources`.
    """
    home = home.rstrip("/")
    return [
        LogSource(agent, tuple(f"{home}/{root}" for root in HOME_ROOTS[agent]), module.normalise, needs=module.needs)
        for agent, module in FORMATS.items()
    ]


def table_sources(database: str | None = None, steps: str | None = None) -> list[TableSource]:
    """The two table-backed sources: the tables of an opencode store as they lie in a database of the catalogue, and
    the name of the table with the steps of all agy conversations."""
    out = [TableSource(opencode.AGENT, lambda spark: opencode.load_tables(spark, database), opencode.read_on)]
    if steps is not None:
        out.append(TableSource(agy.AGENT, lambda spark: {"steps": spark.table(steps)}, agy.read_on))
    return out
