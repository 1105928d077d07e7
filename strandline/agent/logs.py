"""Output of a run in a file as well."""

from __future__ import annotations

import contextlib
import io
import sys
from collections.abc import Iterator


class _Both(io.TextIOBase):
    def __init__(self, *out: io.TextIOBase):
        self.out = out

    def write(self, text: str) -> int:
        for o in self.out:
            o.write(text)
        return len(text)

    def flush(self) -> None:
        for o in self.out:
            o.flush()


@contextlib.contextmanager
def logged(path: str) -> Iterator[None]:
    """What is printed goes to the file ``path`` too, errors among it."""
    with open(path, "a", encoding="utf-8", buffering=1) as file, contextlib.redirect_stdout(_Both(sys.stdout, file)), contextlib.redirect_stderr(_Both(sys.stderr, file)):
        yield
