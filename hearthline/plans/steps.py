"""A plan of named steps over tables: each a function of the tables it needs.

Steps are put in order by what they need. A step's table is stored when its turn comes, so an error
shows in the step that made it and later steps start from what is written. An optional
step that fails, or that needs one which failed, is left out and the rest goes on; any
other failure ends the run. The table of a step is released to nobody but the steps that name it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from hearthline.session import staged


@dataclass(frozen=True)
class Step:
    name: str
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    optional: bool = False


@dataclass
class Outcome:
    tables: dict[str, DataFrame]
    left_out: dict[str, str] = field(default_factory=dict)


def in_order(steps: Iterable[Step], given: Iterable[str] = ()) -> list[Step]:
    """Steps so that each comes after those it needs; equal ones as they were listed."""
    steps, given = list(steps), set(given)
    named = {s.name: s for s in steps}
    if len(named) < len(steps) or given & named.keys():
        raise ValueError("step names must differ from each other and from the given tables")
    for step in steps:
        unknown = [n for n in step.needs if n not in named and n not in given]
        if unknown:
            raise ValueError(f"step {step.name} needs {', '.join(unknown)}, which nothing gives")
    try:
        order = TopologicalSorter({s.name: [n for n in s.needs if n in named] for s in steps}).static_order()
        return [named[name] for name in order]
    except CycleError as error:
        raise ValueError(f"steps need each other: {' <- '.join(error.args[1])}") from error


def run_steps(steps: Iterable[Step], given: Mapping[str, DataFrame] | None = None, wanted: Iterable[str] | None = None) -> Outcome:
    """Run a plan over the given tables; with ``wanted``, only the steps these depend on.

    A step is called with its needs by position.
    """
    given = dict(given or {})
    order = in_order(steps, given)
    if wanted is not None:
        chosen = set(wanted)
        for step in reversed(order):
            if step.name in chosen:
                chosen.update(step.needs)
        unknown = chosen - {s.name for s in order} - given.keys()
        if unknown:
            raise ValueError(f"no step gives {', '.join(sorted(unknown))}")
        order = [s for s in order if s.name in chosen]
    done = Outcome(given)
    for step in order:
        missing = [n for n in step.needs if n in done.left_out]
        if missing and step.optional:
            done.left_out[step.name] = f"needs {', '.join(missing)}"
            continue
        if missing:
            raise RuntimeError(f"step {step.name} needs {', '.join(missing)}: {done.left_out[missing[0]]}")
        try:
            done.tables[step.name] = staged(step.build(*[done.tables[n] for n in step.needs]), step.name)
        except Exception as error:  # whatever ends a Spark job, in Python or the JVM
            if not step.optional:
                raise RuntimeError(f"step {step.name} failed: {error}") from error
            done.left_out[step.name] = str(error)
    return done
