"""Options of a conversion: typed, in groups, given sparsely; some are refused where a request comes from outside."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Option:
    name: str
    group: str
    default: object
    kind: type
    choices: tuple = ()
    #: Names a file of the machine, so a request must not set it.
    local: bool = False

    def parsed(self, given: object) -> object:
        """The value as its type, or ValueError."""
        if self.kind is bool and isinstance(given, str):
            if given.lower() not in ("true", "false", "1", "0", "yes", "no"):
                raise ValueError(f"{self.name}: {given!r} is neither true nor false")
            value: object = given.lower() in ("true", "1", "yes")
        else:
            try:
                value = self.kind(given)
            except (TypeError, ValueError):
                raise ValueError(f"{self.name}: {given!r} is no {self.kind.__name__}") from None
        if self.choices and value not in self.choices:
            raise ValueError(f"{self.name}: {given!r} is none of {', '.join(map(str, self.choices))}")
        return value


REGISTRY = {
    o.name: o
    for o in (
        Option("grid", "doctags", 500, int),
        Option("min_chapter", "book", 400, int),
        Option("pages", "pages", "", str),
        Option("zones", "redaction", "", str),
        Option("headings", "structure", "auto", str, ("auto", "size", "none")),
        Option("tables", "structure", True, bool),
        Option("refine", "structure", False, bool),
        Option("least_confidence", "sources", 0.8, float),
        Option("done_folder", "sources", "", str, local=True),
        Option("font_folder", "sources", "", str, local=True),
    )
}


@dataclass
class Options:
    """What differs from the defaults."""

    given: dict[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict[str, object], from_request: bool = False) -> Options:
        out = {}
        for name, value in values.items():
            option = REGISTRY.get(name)
            if option is None:
                raise ValueError(f"{name}: no such option")
            if from_request and option.local:
                raise ValueError(f"{name}: names a local file and cannot be set by a request")
            parsed = option.parsed(value)
            if parsed != option.default:
                out[name] = parsed
        return cls(out)

    def __getitem__(self, name: str) -> object:
        return self.given.get(name, REGISTRY[name].default)

    def group(self, name: str) -> dict[str, object]:
        return {o.name: self[o.name] for o in REGISTRY.values() if o.group == name}
