"""What to replicate: tables, their keys and the columns subscribed to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

VERSION, OP = "_version", "_op"
META = (VERSION, OP)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$#@]*")


@dataclass(frozen=True)
class TableSpec:
    """A replicated table.

    columns: the subscribed columns, None for all.  shorten: column -> characters kept.
    ignore_case: string keys match without case.  history: keep applied changes.
    method: how changes are applied to a stored target, ``merge``, ``delete_insert`` or ``replace``.
    """

    name: str
    pk: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    schema: str = "dbo"
    shorten: dict[str, int] = field(default_factory=dict)
    ignore_case: bool = False
    history: bool = False
    stop_on_error: bool = True
    method: str = "merge"

    def __post_init__(self) -> None:
        for name in (self.name, self.schema, *self.pk, *(self.columns or ())):
            if not _NAME.fullmatch(name):
                raise ValueError(f"illegal identifier {name!r}")
        if self.method not in ("merge", "delete_insert", "replace"):
            raise ValueError(f"unknown method {self.method}")
        for column, n in self.shorten.items():
            if not isinstance(n, int) or n < 1:
                raise ValueError(f"{column}: a column is shortened to one positive number of characters, not {n!r}")

    def wants(self, column: str) -> bool:
        return self.columns is None or column.lower() in {c.lower() for c in (*self.columns, *self.pk)}

    def both(self, other: TableSpec) -> TableSpec:
        """The effective subscription of a publisher's and a subscriber's spec of one table.

        With lists on both sides the columns are the intersection, else whichever list there is;
        where both shorten a column the smaller length counts.
        """
        if self.columns is not None and other.columns is not None:
            theirs = {c.lower() for c in other.columns}
            columns = tuple(c for c in self.columns if c.lower() in theirs)
        else:
            columns = self.columns if self.columns is not None else other.columns
        mine = {k.lower(): v for k, v in self.shorten.items()}
        for k, v in other.shorten.items():
            mine[k.lower()] = min(v, mine.get(k.lower(), v))
        return TableSpec(self.name, self.pk or other.pk, columns, self.schema, mine, self.ignore_case or other.ignore_case, self.history or other.history, self.stop_on_error, other.method)
