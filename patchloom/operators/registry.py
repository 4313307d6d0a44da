"""Detectors by name: what each needs, in which order they run, and their findings as one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables by name, those of the detectors that ran before among them.
Inputs = dict[str, DataFrame]
#: Told a detector's name and its state: started, completed or failed.
Listener = Callable[[str, str], None]


@dataclass(frozen=True)
class Detector:
    name: str
    label: str
    run: Callable[[Inputs], DataFrame]
    needs: tuple[str, ...] = ()


class Registry:
    def __init__(self, detectors: Iterable[Detector] = ()):
        self._by_name: dict[str, Detector] = {}
        for detector in detectors:
            self.add(detector)

    def add(self, detector: Detector) -> Detector:
        """A detector of a known name replaces it in its place."""
        self._by_name[detector.name] = detector
        return detector

    def names(self) -> list[str]:
        return list(self._by_name)

    def first(self) -> Detector | None:
        """The first that needs no other."""
        return next((d for d in self._by_name.values() if not d.needs), None)

    def last(self) -> list[str]:
        """Those that no other needs."""
        needed = {name for d in self._by_name.values() for name in d.needs}
        return [name for name in self._by_name if name not in needed]

    def in_order(self) -> list[Detector]:
        """Every detector after those it needs, otherwise as added."""
        out: dict[str, Detector] = {}
        waiting = list(self._by_name.values())
        while waiting:
            ready = [d for d in waiting if all(n in out for n in d.needs)]
            if not ready:
                raise ValueError(f"detectors need each other or unknown ones: {', '.join(d.name for d in waiting)}")
            out[ready[0].name] = ready[0]
            waiting.remove(ready[0])
        return list(out.values())

    def run(self, inputs: Inputs, listener: Listener | None = None) -> DataFrame | None:
        """The findings of all detectors with their agent; one whose plan fails is told to the listener and left out, with what needs it."""
        tell = listener or (lambda name, state: None)
        known, found = dict(inputs), None
        for detector in self.in_order():
            tell(detector.name, "started")
            try:
                if any(n not in known for n in detector.needs):
                    raise LookupError(detector.needs)
                known[detector.name] = rows = detector.run(known)
            except Exception:  # noqa: BLE001
                tell(detector.name, "failed")
                continue
            tell(detector.name, "completed")
            named = rows.withColumn("agent", F.lit(detector.name))
            found = named if found is None else found.unionByName(named, allowMissingColumns=True)
        return found
