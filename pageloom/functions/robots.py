"""Rules of robots files: reading them, and the longest that matches a path."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator


def rules_of(text: str) -> Iterator[tuple[str, bool, str]]:
    """``agent, allow, pattern`` of a robots file, in order; a rule without a pattern forbids nothing, but its group holds."""
    agents: list[str] = []
    ruled = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
        elif key in ("allow", "disallow"):
            ruled = True
            for agent in agents:
                yield agent, key == "allow", value


class RuleTrie:
    """Patterns under the characters before their first wildcard; one walk along a path meets all that can match."""

    def __init__(self, rules: Iterable[tuple[str, bool]]):
        self.root: dict = {}
        for pattern, allow in rules:
            if not pattern:
                continue
            at = next((k for k, c in enumerate(pattern) if c == "*" or (c == "$" and k == len(pattern) - 1)), len(pattern))
            node = self.root
            for c in pattern[:at]:
                node = node.setdefault(c, {})
            rest = pattern[at:]
            ends = rest.endswith("$")
            steps = re.compile(".*".join(map(re.escape, re.split(r"\*+", rest[:-1] if ends else rest))) + ("$" if ends else ""), re.S) if rest else None
            node.setdefault("", []).append((len(pattern), allow, steps))

    def allows(self, path: str) -> bool:
        """By the longest matching pattern, allowing on a tie and without any."""
        met, node = [], self.root
        for at in range(len(path) + 1):
            met += [(size, allow, steps, at) for size, allow, steps in node.get("", ())]
            node = node.get(path[at]) if at < len(path) else None
            if node is None:
                break
        met.sort(key=lambda m: m[:2], reverse=True)
        return next((allow for _, allow, steps, at in met if steps is None or steps.match(path, at)), True)
