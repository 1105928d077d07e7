"""Pools of model clients, calls that are tried again, and judges."""

from __future__ import annotations

import asyncio
import json
import re
from collections.abc import Awaitable, Callable
from dataclasses import dataclass, field
from typing import Any

#: A model: messages and settings in, a reply (text, usage, logprobs) out.
Model = Callable[..., Awaitable[dict[str, Any]]]
LEAST_TOKENS = 32


def fewer_tokens(message: str, current: int) -> int:
    """max_tokens after an overflow: half, or what the message says is left less 64."""
    limit, used = (re.search(p, message, re.I) for p in (r"maximum context length is (\d+)", r"contains at least (\d+) input tokens"))
    room = int(limit[1]) - int(used[1]) - 64 if limit and used else current
    return max(LEAST_TOKENS, min(current // 2, max(LEAST_TOKENS, room)))


@dataclass
class Pool:
    """Clients in turn; calls of one session go to one client."""

    clients: list[Model]
    tries: int = 3
    wait: float = 1.0
    turn: int = 0
    sessions: dict[str, int] = field(default_factory=dict)

    def client(self, session: str | None = None) -> Model:
        if session in self.sessions:
            return self.clients[self.sessions[session]]
        at = self.turn
        self.turn = (at + 1) % len(self.clients)
        if session is not None:
            self.sessions[session] = at
        return self.clients[at]

    async def complete(self, messages: list[dict[str, str]], session: str | None = None, max_tokens: int = 8192, **settings: Any) -> dict[str, Any]:
        """A reply, tried again with longer and longer waits; settings that a client doesn't know are left out, an overflow asks for fewer tokens."""
        ask = self.client(session)
        for number in range(self.tries):
            try:
                return await ask(messages, max_tokens=max_tokens, **settings)
            except Exception as e:
                said = str(e).lower()
                if number + 1 == self.tries:
                    raise
                for name in ("logprobs", "stop"):
                    if name in said and name in settings:
                        settings = {k: v for k, v in settings.items() if not k.endswith(name)}
                        break
                else:
                    if "context length" in said:
                        max_tokens = fewer_tokens(said, max_tokens)
                    else:
                        await asyncio.sleep(self.wait * 2**number)
        raise RuntimeError("no try was made")

    def complete_now(self, messages: list[dict[str, str]], **settings: Any) -> dict[str, Any]:
        return asyncio.run(self.complete(messages, **settings))


def score_of(reply: str) -> float:
    """``score`` of the first JSON object of a judge's reply within 0 and 1; 0 where there is none."""
    for m in re.finditer(r"\{", reply or ""):
        try:
            value = json.JSONDecoder().raw_decode(reply, m.start())[0]
            return min(max(float(value["score"]), 0.0), 1.0)
        except (ValueError, KeyError, TypeError):
            continue
    return 0.0


async def judge(pool: Pool, prompt: str, **settings: Any) -> float:
    """What a model thinks of a step, before or after it is taken."""
    return score_of((await pool.complete([{"role": "user", "content": prompt}], **settings))["text"])
