"""What a stream writes for each epoch, in a number of folders that grows with the logarithm of the epochs.

Every epoch of a query writes a folder of its own. At each epoch that a power of `fan` divides, the
folders of the epochs before it, as many as the power, are folded into one. Names tell which epochs a
folder holds, and a folder counts once its write has ended, so nothing is renamed and no pointer is
switched: a reader takes the widest folders and leaves out what they cover.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tableferry.sources.files import child_names, exists, remove

_MARK = "_SUCCESS"


@dataclass(frozen=True)
class Piece:
    """A folder with the rows of the epochs `first` to `last` of one query."""

    name: str
    query: str
    first: int
    last: int


def _piece(name: str) -> Piece | None:
    kind, _, rest = name.partition("=")
    if kind == "epoch":
        query, _, number = rest.rpartition("-")
        return Piece(name, query, int(number), int(number))
    if kind == "fold":
        query, first, last = rest.rsplit("-", 2)
        return Piece(name, query, int(first), int(last))
    return None


def uncovered(pieces: list[Piece]) -> list[Piece]:
    """The pieces that lie in no other piece of their query; pieces never overlap in part."""
    kept: list[Piece] = []
    for piece in sorted(pieces, key=lambda p: (p.query, p.first, -p.last)):
        if not kept or kept[-1].query != piece.query or piece.last > kept[-1].last:
            kept.append(piece)
    return kept


@dataclass(frozen=True)
class EpochFolders:
    """Folders below `path`, folded `fan` at a time.

    A query that has run n epochs leaves at most (fan - 1) log n folders to read, give or take one level, and
    each row is rewritten log n times. `fan` may change between runs.
    """

    path: str
    fan: int = 10

    def __post_init__(self) -> None:
        if self.fan < 2:
            raise ValueError("fan must be 2 at least")

    def write(self, rows: DataFrame, query: str, epoch: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Write the rows of an epoch, replacing those of an earlier try.

        Only epochs before this one are folded: they are committed and don't run again. `fold` must give the
        same rows for a folder as for the folders it was folded from.
        """
        self._fold_before(rows.sparkSession, query, epoch, fold)
        self._save(rows, f"epoch={query}-{epoch:012d}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all queries; FileNotFoundError when no epoch has ended yet."""
        pieces = uncovered(self.pieces(spark))
        if not pieces:
            raise FileNotFoundError(self.path)
        return self._read(spark, pieces)

    def pieces(self, spark: SparkSession) -> list[Piece]:
        """All folders whose write has ended, covered ones too."""
        named = [p for p in map(_piece, child_names(spark, self.path)) if p]
        return [p for p in named if exists(spark, f"{self.path}/{p.name}/{_MARK}")]

    def _fold_before(self, spark: SparkSession, query: str, epoch: int, fold) -> None:
        if not epoch or epoch % self.fan:
            return
        size = self.fan
        while epoch % (size * self.fan) == 0:
            size *= self.fan
        pieces = [p for p in self.pieces(spark) if p.query == query]
        current = uncovered(pieces)
        due = [p for p in current if p.first >= epoch - size and p.last < epoch]
        if len(due) > 1:
            self._save(fold(self._read(spark, due)), f"fold={query}-{due[0].first:012d}-{due[-1].last:012d}")
        # What this fold covers stays until the next one, for those who are reading it now.
        for piece in set(pieces) - set(current):
            remove(spark, f"{self.path}/{piece.name}")

    def _read(self, spark: SparkSession, pieces: list[Piece]) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/{p.name}" for p in pieces])

    def _save(self, rows: DataFrame, name: str) -> None:
        marked = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "true"}
        rows.write.mode("overwrite").options(**marked).parquet(f"{self.path}/{name}")
