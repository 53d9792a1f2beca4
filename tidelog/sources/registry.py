"""A schema registry in memory: subjects, ids, and the BACKWARD rule for new versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..schemas import COMMANDS, MESSAGES, NAMESPACE, type_name

#: The topic of each message.
TOPICS = {m: "inventory.commands" if m in COMMANDS else "inventory.events" for m in MESSAGES}


@dataclass
class Registry:
    """Ids are given in order of registration; readers never register and fail on an absent subject."""

    versions: dict[str, list[dict[int, str]]] = field(default_factory=dict)
    ids: dict[tuple[str, int], int] = field(default_factory=dict)

    def register(self, subject: str, fields: dict[int, str]) -> int:
        """fields: number to 'name type'. An equal schema keeps its id; one that cannot read the last is refused."""
        known = self.versions.setdefault(subject, [])
        if fields in known:
            return self.ids[subject, known.index(fields)]
        if known and (why := broken(known[-1], fields)):
            raise ValueError(f"{subject}: {why}")
        known.append(fields)
        self.ids[subject, len(known) - 1] = len(self.ids) + 1
        return len(self.ids)

    def lookup(self, subject: str) -> int:
        if not self.versions.get(subject):
            raise KeyError(f"subject {subject} is not registered")
        return self.ids[subject, len(self.versions[subject]) - 1]


def broken(old: dict[int, str], new: dict[int, str]) -> str:
    """Why data of old cannot be read as new; empty if it can: a number keeps its type, fields may come and go."""
    for number, declared in old.items():
        if number in new and new[number].split()[-1] != declared.split()[-1]:
            return f"field {number} changes from {declared.split()[-1]} to {new[number].split()[-1]}"
    return ""


def one_level(answers: list[tuple[str | None, str | None]]) -> str | None:
    """One compatibility level from what several registries answered, as (level, error): the first error is raised, else the last level counts."""
    level = None
    for said, error in answers:
        if error is not None:
            raise RuntimeError(error)
        level = said
    return level


def ensure_backward(set_level: Callable[[str], list], read_level: Callable[[], list]) -> None:
    """Sets the global level to BACKWARD, then reads it back: what a registry echoes while it is set proves nothing."""
    one_level(set_level("BACKWARD"))
    level = one_level(read_level())
    if level != "BACKWARD":
        raise RuntimeError(f"global compatibility is {level}, want BACKWARD")


def default_registry(namespace: str = NAMESPACE) -> Registry:
    out = Registry()
    for message, fields in MESSAGES.items():
        out.register(f"{TOPICS[message]}-{type_name(message, namespace)}", {i + 1: f"{f} {'timestamp' if f == 'expires_at' else 'string'}" for i, f in enumerate(fields)})
    return out
