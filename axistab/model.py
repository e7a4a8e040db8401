"""Tables whose columns are arrays over named axes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

ROW = "row"


@dataclass(frozen=True)
class AxisSet:
    """Named axes; columns of sets with different uids never conform."""

    uid: str
    names: tuple[str, ...]

    def conforms(self, index_axes: AxisSet, is_index: bool = False) -> bool:
        """Whether a column over these axes may belong to a table with ``index_axes``.

        The uids must agree. The table's index axes must lead the column's, in order; an index column (``is_index``) has
        one axis, which must be one of the table's index axes.
        """
        if self.uid != index_axes.uid:
            return False
        if is_index:
            return len(self.names) == 1 and self.names[0] in index_axes.names
        return self.names[: len(index_axes.names)] == index_axes.names


@dataclass(frozen=True)
class AxisTable:
    """A fact DataFrame with a coordinate column for every index axis, and a dimension ``coord, value`` for each but ROW.

    The coordinate of axis ``a`` is the column ``a_at``, that of ROW is ``row``.
    """

    df: DataFrame
    index_axes: tuple[str, ...] = (ROW,)
    dims: dict[str, DataFrame] = field(default_factory=dict)
    uid: str = ""

    @property
    def axes(self) -> AxisSet:
        return AxisSet(self.uid, self.index_axes)

    @property
    def coords(self) -> list[str]:
        return [at(a) for a in self.index_axes]


def at(axis: str) -> str:
    """The coordinate column of an axis."""
    return axis if axis == ROW else f"{axis}_at"
