"""Runs of named stages in the order of their needs, with selection and resume."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lattica.operators import store


@dataclass(frozen=True)
class Stage:
    """A step that makes one table from those of the stages it ``needs``."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def in_order(stages: Iterable[Stage], wanted: Iterable[str] | None = None) -> list[Stage]:
    """The wanted stages (all by default) and all they need, each after its needs; equals in the order given.
    ValueError on an unknown name or a circle."""
    known = {s.name: s for s in stages}
    out: dict[str, Stage] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("stages need each other: " + " > ".join((*above, name)))
        if name not in known:
            raise ValueError(f"no stage {name!r}")
        for need in known[name].needs:
            visit(need, (*above, name))
        out.setdefault(name, known[name])

    for name in known if wanted is None else wanted:
        visit(name, ())
    return list(out.values())


def run(spark: SparkSession, stages: Iterable[Stage], folder: str, wanted: Iterable[str] | None = None, resume: bool = True) -> dict[str, tuple[DataFrame, bool]]:
    """(table, whether it was made now) of the wanted stages and their needs.  With ``resume`` a stage whose table is in
    ``folder`` is not run again; without, every stage is, and its table replaced."""
    done: dict[str, tuple[DataFrame, bool]] = {}
    for s in in_order(stages, wanted):
        path = f"{folder}/{s.name}"
        old = store.read(spark, path) if resume else None
        done[s.name] = (old, False) if old is not None else (store.publish(s.make(*[done[n][0] for n in s.needs]), path), True)
    return done
