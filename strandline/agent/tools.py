"""Tools that act on the text between their tags, and the sandbox for programs."""

from __future__ import annotations

import ast
import asyncio
import re
import sys
from abc import ABC, abstractmethod


class Tool(ABC):
    """A tool by its name and the tag that calls it."""

    name: str
    tag: str

    @abstractmethod
    async def execute(self, content: str) -> str: ...


class PythonSandbox(Tool):
    """Runs programs in a process of their own, so many at a time; the last expression is printed."""

    name, tag = "python_interpreter", "python"

    def __init__(self, python: str = sys.executable, at_once: int = 10, timeout: float = 1200.0):
        self.python, self.timeout, self.gate = python, timeout, asyncio.Semaphore(at_once)

    async def execute(self, content: str) -> str:
        async with self.gate:
            try:
                run = await asyncio.create_subprocess_exec(self.python, "-c", printed(content), stdout=asyncio.subprocess.PIPE, stderr=asyncio.subprocess.PIPE)
            except OSError as e:
                return f"Error: {e}"
            try:
                out, err = await asyncio.wait_for(run.communicate(), self.timeout)
            except TimeoutError:
                run.kill()
                await run.wait()
                return "Execution Timeout"
            return (out if run.returncode == 0 else err).decode(errors="replace").strip()


def printed(code: str) -> str:
    """The program with its last expression printed, unless it prints already; as it is where it doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return code
    last = tree.body[-1] if tree.body else None
    if not isinstance(last, ast.Expr) or (isinstance(last.value, ast.Call) and getattr(last.value.func, "id", "") == "print"):
        return code
    tree.body[-1] = ast.Expr(ast.Call(ast.Name("print", ast.Load()), [last.value], []))
    return ast.unparse(ast.fix_missing_locations(tree))


class Toolbox:
    """Finds and runs the tool that a reply calls last."""

    def __init__(self, *tools: Tool):
        self.by_tag = {t.tag: t for t in tools}

    def called(self, reply: str) -> tuple[Tool, str] | None:
        found = [(m.end(), t, m[1]) for t in self.by_tag.values() for m in re.finditer(rf"(?s)<{t.tag}>(.*?)</{t.tag}>", reply)]
        return (lambda f: (f[1], f[2].strip()))(max(found, key=lambda f: f[0])) if found else None

    async def run(self, reply: str) -> str | None:
        call = self.called(reply)
        return await call[0].execute(call[1]) if call else None
