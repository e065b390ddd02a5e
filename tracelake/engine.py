"""The extension surface: hooks, modules, options, attributes, and what a view shares with others.

A hook here is a function from events to events, run by priority, lowest first; what it returns takes the place of what
it was given, and None leaves that as it was. Everything in this module is small and lives on the driver; the work is in
the DataFrames that hooks return.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.adapter import in_time, of_types

#: The range of priorities and the one that a hook has by default.
FIRST, DEFAULT, LAST = 0, 50, 99
Hook = Callable[[DataFrame], DataFrame | None]


class Hooks:
    """Hooks in the order of their priority, those of equal priority in the order in which they were added."""

    def __init__(self) -> None:
        self._held: list[tuple[int, Hook]] = []

    def add(self, hook: Hook, priority: int = DEFAULT) -> None:
        if not FIRST <= priority <= LAST:
            raise ValueError(f"a priority is from {FIRST} to {LAST}")
        self._held.append((priority, hook))
        self._held.sort(key=lambda h: h[0])

    def remove(self, hook: Hook) -> None:
        for k, (_, held) in enumerate(self._held):
            if held is hook:
                del self._held[k]
                return
        raise KeyError("the hook is not in the list")

    def __iter__(self) -> Iterator[Hook]:
        return iter([hook for _, hook in self._held])

    def __len__(self) -> int:
        return len(self._held)

    def call(self, events: DataFrame) -> DataFrame:
        for hook in self:
            found = hook(events)
            events = events if found is None else found
        return events

    def until(self, done: Callable[[DataFrame], bool], events: DataFrame) -> tuple[DataFrame, bool]:
        """Calls hooks until what one returns is what was wanted."""
        for hook in self:
            found = hook(events)
            events = events if found is None else found
            if done(events):
                return events, True
        return events, False

    @staticmethod
    def merged(*lists: Hooks) -> Hooks:
        """All hooks of several lists by priority; of equal ones those of the earlier list come first."""
        out = Hooks()
        for each in lists:
            for priority, hook in each._held:
                out.add(hook, priority)
        return out


class EventHooks:
    """Hooks for all events, and for events of one name with the fields that they need."""

    def __init__(self) -> None:
        self.all, self._named = Hooks(), {}

    def bind(self, event: str, fields: Mapping[str, str], hook: Hook, priority: int = DEFAULT) -> None:
        """The hook gets the events of that name, their fields cast to the types named. An event table that lacks a
        field is an error when the hooks run, as a hook would read nothing."""
        self._named.setdefault(event, []).append((dict(fields), hook, priority))

    def call(self, events: DataFrame) -> dict[str, list[DataFrame]]:
        """What the bound hooks return, by event; each reads its own typed view."""
        events, out = self.all.call(events), {}
        for event, bound in self._named.items():
            for fields, hook, _ in sorted(bound, key=lambda b: b[2]):
                missing = [f for f in fields if f not in events.columns]
                if missing:
                    raise KeyError(f"events have no field {', '.join(missing)} for {event}")
                view = of_types(events, event).withColumns({f: F.col(f).cast(kind) for f, kind in fields.items()})
                found = hook(view)
                if found is not None:
                    out.setdefault(event, []).append(found)
        return out


@dataclass
class Run:
    """A pass over a trace set: what is called before and after all of it, each trace, and each tracefile."""

    before_traceset: Hooks = field(default_factory=Hooks)
    before_trace: Hooks = field(default_factory=Hooks)
    before_tracefile: Hooks = field(default_factory=Hooks)
    events: EventHooks = field(default_factory=EventHooks)
    after_tracefile: Hooks = field(default_factory=Hooks)
    after_trace: Hooks = field(default_factory=Hooks)
    after_traceset: Hooks = field(default_factory=Hooks)

    def process(self, events: DataFrame, start: int | None = None, end: int | None = None) -> tuple[DataFrame, dict[str, list[DataFrame]]]:
        """The events as the hooks leave them, and what the bound hooks made of them."""
        events = in_time(events, start, end)
        for hooks in (self.before_traceset, self.before_trace, self.before_tracefile):
            events = hooks.call(events)
        made = self.events.call(events)
        for hooks in (self.after_tracefile, self.after_trace, self.after_traceset):
            events = hooks.call(events)
        return events, made


@dataclass
class Module:
    name: str
    begin: Callable[[], None] = lambda: None
    end: Callable[[], None] = lambda: None
    needs: Sequence[str] = ()


class Modules:
    """Modules by name. A module begins when it is first required, after those that it needs, and ends when as many
    releases as requirements have been made."""

    def __init__(self) -> None:
        self._known: dict[str, Module] = {}
        self._uses: dict[str, int] = {}

    def register(self, module: Module) -> None:
        self._known[module.name] = module

    def require(self, name: str, _asking: tuple[str, ...] = ()) -> None:
        if name not in self._known:
            raise KeyError(f"there is no module {name}")
        if name in _asking:
            raise ValueError(f"modules need each other: {' -> '.join((*_asking, name))}")
        for other in self._known[name].needs:
            self.require(other, (*_asking, name))
        if not self._uses.get(name):
            self._known[name].begin()
        self._uses[name] = self._uses.get(name, 0) + 1

    def release(self, name: str) -> None:
        if not self._uses.get(name):
            raise KeyError(f"{name} is not in use")
        self._uses[name] -= 1
        if not self._uses[name]:
            self._known[name].end()
        for other in reversed(self._known[name].needs):
            self.release(other)

    def active(self) -> list[str]:
        return [name for name, n in self._uses.items() if n]


@dataclass
class Option:
    name: str
    short: str
    help: str
    kind: type | None = None
    value: Any = None
    called: Callable[[Any], None] | None = None


class Options:
    """Options of a command line; those without a kind take no value and become true."""

    def __init__(self) -> None:
        self._held: dict[str, Option] = {}

    def add(self, name: str, short: str = "", help: str = "", kind: type | None = None, value: Any = None, called: Callable[[Any], None] | None = None) -> None:
        self._held[name] = Option(name, short, help, kind, False if kind is None and value is None else value, called)

    def remove(self, name: str) -> None:
        del self._held[name]

    def __getitem__(self, name: str) -> Any:
        return self._held[name].value

    def parse(self, words: Sequence[str]) -> list[str]:
        """Sets the options in words, and returns what is none of them."""
        rest, left = [], list(words)
        short = {o.short: o for o in self._held.values() if o.short}
        while left:
            word = left.pop(0)
            name, given, value = word.lstrip("-").partition("=") if word.startswith("-") else ("", "", "")
            option = (self._held.get(name) if word.startswith("--") else short.get(name)) if name else None
            if option is None:
                if word.startswith("-"):
                    raise ValueError(f"there is no option {word}")
                rest.append(word)
                continue
            if option.kind is None:
                option.value = True
            else:
                if not given and not left:
                    raise ValueError(f"{word} needs a value")
                option.value = option.kind(value if given else left.pop(0))
            if option.called:
                option.called(option.value)
        return rest

    def usage(self) -> str:
        return "\n".join(f"  {'-' + o.short + ', ' if o.short else '    '}--{o.name}{'' if o.kind is None else ' ' + o.kind.__name__.upper()}  {o.help}" for o in self._held.values())


class Attributes:
    """A tree of named values, each found by a path such as ``hooks/event``."""

    def __init__(self) -> None:
        self._values: dict[str, Any] = {}

    def __len__(self) -> int:
        return len(self._values)

    def names(self) -> list[str]:
        return list(self._values)

    def get(self, name: str) -> Any:
        return self._values[name]

    def at(self, k: int) -> tuple[str, Any]:
        return list(self._values.items())[k]

    def add(self, name: str, value: Any) -> None:
        self._values[name] = value

    def remove(self, name: str) -> None:
        del self._values[name]

    def directory(self, name: str) -> Attributes:
        """The subtree of that name, made if there is none; whatever else has the name gives way."""
        if not isinstance(self._values.get(name), Attributes):
            self._values[name] = Attributes()
        return self._values[name]

    def find(self, path: str, kind: type | None = None) -> Any:
        """The value of a path; with a kind, one of that kind is made where there is none."""
        *above, last = path.strip("/").split("/")
        at = self
        for name in above:
            at = at.directory(name)
        if last not in at._values or kind is not None and not isinstance(at._values[last], kind):
            if kind is None:
                raise KeyError(path)
            at._values[last] = kind()
        return at._values[last]

    def put(self, path: str, value: Any) -> None:
        *above, last = path.strip("/").split("/")
        at = self
        for name in above:
            at = at.directory(name)
        at._values[last] = value

    def plus(self, other: Attributes) -> Attributes:
        """The other tree added to this one: numbers are summed, trees joined, the rest taken over where it is new."""
        for name, value in other._values.items():
            if isinstance(value, Attributes):
                self.directory(name).plus(value)
            elif isinstance(value, (int, float)) and not isinstance(value, bool):
                self._values[name] = self._values.get(name, 0) + value
            else:
                self._values.setdefault(name, value)
        return self

    def rows(self, above: tuple[str, ...] = ()) -> Iterator[tuple[str, Any]]:
        for name, value in self._values.items():
            if isinstance(value, Attributes):
                yield from value.rows((*above, name))
            else:
                yield "/".join((*above, name)), value

    def to_xml(self) -> str:
        def element(tree: Attributes) -> ET.Element:
            out = ET.Element("ATTRS")
            for name, value in tree._values.items():
                if isinstance(value, Attributes):
                    below = ET.SubElement(out, "ATTR", {"NAME": name, "TYPE": "ATTRS"})
                    below.append(element(value))
                else:
                    ET.SubElement(out, "ATTR", {"NAME": name, "TYPE": type(value).__name__, "VALUE": str(value)})
            return out

        return ET.tostring(element(self), encoding="unicode")

    @classmethod
    def from_xml(cls, text: str) -> Attributes:
        kinds: dict[str, Callable[[str], Any]] = {"int": int, "float": float, "str": str, "bool": lambda v: v == "True", "NoneType": lambda v: None}

        def tree(element: ET.Element) -> Attributes:
            out = cls()
            for e in element:
                out.add(e.attrib["NAME"], tree(e[0]) if e.attrib["TYPE"] == "ATTRS" else kinds[e.attrib["TYPE"]](e.attrib["VALUE"]))
            return out

        return tree(ET.fromstring(text))


class View:
    """What several views of one trace set share. Each change is told to those that asked for its kind."""

    KINDS = ("time_window", "current_time", "position", "filter", "traceset")

    def __init__(self, events: DataFrame) -> None:
        self._state: dict[str, Any] = {"time_window": (None, None), "current_time": None, "position": None, "filter": None, "traceset": events}
        self._told: dict[str, list[Callable[[Any], None]]] = {k: [] for k in self.KINDS}

    def on(self, kind: str, told: Callable[[Any], None]) -> None:
        self._told[kind].append(told)

    def off(self, kind: str, told: Callable[[Any], None]) -> None:
        self._told[kind].remove(told)

    def __getitem__(self, kind: str) -> Any:
        return self._state[kind]

    def set(self, kind: str, value: Any) -> None:
        if kind not in self._state:
            raise KeyError(f"a view has no {kind}")
        self._state[kind] = value
        for told in self._told[kind]:
            told(value)

    def events(self) -> DataFrame:
        """The events that the view shows: those of its time window that pass its filter."""
        shown = in_time(self._state["traceset"], *self._state["time_window"])
        return shown if self._state["filter"] is None else shown.where(self._state["filter"])


class Processing(Protocol):
    """What brings packets into a synchronisation."""

    def packets(self, events: DataFrame) -> DataFrame: ...


class Matching(Protocol):
    def messages(self, packets: DataFrame) -> DataFrame: ...


class Analysis(Protocol):
    def pairs(self, messages: DataFrame) -> DataFrame: ...


class Reduction(Protocol):
    def factors(self, pairs: list[tuple], traces: int) -> list[tuple]: ...


@dataclass
class SyncModules:
    """The modules that a synchronisation is put together from, by name, one queue for each step."""

    processing: dict[str, Processing] = field(default_factory=dict)
    matching: dict[str, Matching] = field(default_factory=dict)
    analysis: dict[str, Analysis] = field(default_factory=dict)
    reduction: dict[str, Reduction] = field(default_factory=dict)

    def register(self, step: str, name: str, module: Any) -> None:
        getattr(self, step)[name] = module


def cancelled(events: DataFrame, check: Callable[[], bool], group: str, seconds: float = 0.2) -> Callable[[Callable[[DataFrame], Any]], Any]:
    """Runs an action on events that stops when check becomes true: it is asked every so often while the job runs, and
    then the job's group is cancelled."""
    import threading

    spark = events.sparkSession

    def run(action: Callable[[DataFrame], Any]) -> Any:
        done = threading.Event()

        def watch() -> None:
            while not done.wait(seconds):
                if check():
                    spark.sparkContext.cancelJobGroup(group)

        watcher = threading.Thread(target=watch, daemon=True)
        spark.sparkContext.setJobGroup(group, "an action that a view may stop", interruptOnCancel=True)
        watcher.start()
        try:
            return action(events)
        finally:
            done.set()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return run
