"""Loops that grow trajectories: tree search, step-by-step chains, questions made and answers repaired, batches of datasets."""

from __future__ import annotations

import math
from collections.abc import Awaitable, Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

#: Kinds of action that a step may have.
ACTIONS = ("list_dir", "inspect_schema", "inspect_content", "stats", "cross_file_join", "validate_claim", "visualize", "debug")


@dataclass
class Node:
    id: str
    parent: Node | None = None
    action: Any = None
    observation: str = ""
    r_pre: float = 0.0
    r_post: float | None = None
    visits: int = 0
    q: float = 0.0
    expandable: bool = True
    children: list[Node] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return 0 if self.parent is None else self.parent.depth + 1

    def path(self) -> list[Node]:
        return ([] if self.parent is None else self.parent.path()) + [self]


@dataclass
class Search:
    """Tree search with the model behind four functions; ``run`` gives the root."""

    propose: Callable[[Node, int], Awaitable[list[tuple[Any, float]]]]
    execute: Callable[[Node], Awaitable[str]]
    assess: Callable[[Node], Awaitable[float]]
    rollouts: int = 24
    children: int = 1
    max_depth: int = 8
    explore: float = 1.0
    first_play: float = 0.1
    depth_bonus: float = 0.05
    tau_pre: float = 0.0
    tau_post: float = 0.0

    def value(self, n: Node) -> float:
        log = math.sqrt(math.log(max(n.parent.visits, 1) + 1))
        bonus = self.depth_bonus * n.depth
        if n.visits:
            return n.q + self.explore * n.r_pre * log / math.sqrt(1 + n.visits) + bonus
        seen = [c.q - c.r_pre for c in n.parent.children if c.visits]
        return max(n.r_pre + (sum(seen) / len(seen) if seen else 0.0) - self.first_play, 0.0) + self.explore * n.r_pre * log + bonus

    def select(self, root: Node) -> Node:
        at = root
        while ready := [c for c in at.children if c.expandable]:
            at = max(ready, key=lambda c: (self.value(c), c.id))
        return at

    async def expand(self, n: Node, rollout: int) -> list[Node]:
        proposed = sorted(await self.propose(n, rollout), key=lambda x: -x[1])
        taken = [(a, p) for a, p in proposed if p >= self.tau_pre and a not in [c.action for c in n.children]][: self.children]
        made = [Node(f"{n.id}.{len(n.children) + k}", n, a, r_pre=p) for k, (a, p) in enumerate(taken)]
        n.children += made
        n.expandable = n.expandable and bool(made)
        return made

    async def run(self, root: Node) -> Node:
        for rollout in range(self.rollouts):
            at = self.select(root)
            if not at.expandable:
                break
            if at.depth >= self.max_depth:
                at.expandable = False
                continue
            for child in await self.expand(at, rollout):
                child.observation = await self.execute(child)
                child.r_post = await self.assess(child)
                child.expandable = child.r_post >= self.tau_post
                for n in child.path():
                    n.visits += 1
                    n.q += (child.r_post - n.q) / n.visits
        return root


async def chain(think: Callable[[list[tuple[str, Any, str]]], Awaitable[tuple[str, dict | None]]], execute: Callable[[str], Awaitable[str]], max_steps: int = 15) -> list[tuple[str, Any, str]]:
    """Steps (thought, action, observation) until STOP, no action, or the last step; a program that was run isn't run again."""
    steps: list[tuple[str, Any, str]] = []
    done: set[str] = set()
    for _ in range(max_steps):
        thought, action = await think(steps)
        if action is None or str(action.get("tool_name", "")).upper() == "STOP":
            steps.append((thought, action, ""))
            break
        code = str(action.get("code", "")).strip()
        seen = code in done
        done.add(code)
        steps.append((thought, action, "This code was run before; try something else." if seen else await execute(code)))
    return steps


async def with_feedback(make: Callable[[str, int], Awaitable[Any]], check: Callable[[Any], str | None], tries: int = 3) -> Any | None:
    """What ``make`` gives, with the reason of the last failure as its input, until ``check`` finds none; None after all tries."""
    reason = ""
    for number in range(1, tries + 1):
        try:
            made = await make(reason, number)
        except Exception as e:
            reason = str(e)
            continue
        reason = check(made) or ""
        if not reason:
            return made
    return None


async def repaired(trees: Iterable[dict], find: Callable[[dict], dict | None], again: Callable[[dict, dict], Awaitable[list[str] | None]], max_fixes: int | None = None, dry: bool = False) -> tuple[list[dict], int]:
    """(trees, fixes): bad leaves with their logs made again, up to so many; a dry run only counts."""
    out, fixes = [], 0
    for tree in trees:
        leaf = find(tree) if max_fixes is None or fixes < max_fixes else None
        logs = ["dry"] if leaf is not None and dry else await again(tree, leaf) if leaf is not None else None
        if logs:
            fixes += 1
            if not dry:
                tree = tree | {"nodes": [n | {"logs": logs} if n["node_id"] == leaf["node_id"] else n for n in tree["nodes"]]}
        out.append(tree)
    return out, fixes


def batch(names: Iterable[str], run: Callable[[str], int], stop_on_error: bool = False) -> dict[str, int]:
    """Exit codes of ``run`` for each dataset, in order of their names; the rest is left out after a failure, if wanted."""
    out: dict[str, int] = {}
    for name in sorted(names):
        out[name] = run(name)
        if out[name] and stop_on_error:
            break
    return out
