"""Tools, pools and loops with models that are plain functions."""

import asyncio

import pytest

from strandline.agent import loops, models, tools


def test_sandbox_and_toolbox():
    box = tools.Toolbox(tools.PythonSandbox(timeout=20))
    assert asyncio.run(box.run("<think>x</think><python>a = 2\na + 3</python>")) == "5"
    assert asyncio.run(box.run("no call")) is None
    assert "ZeroDivisionError" in asyncio.run(box.run("<python>1/0</python>"))
    assert asyncio.run(tools.PythonSandbox(timeout=0.2).execute("while True: pass")) == "Execution Timeout"
    assert tools.printed("print(1)") == "print(1)" and tools.printed("x = (") == "x = (" and tools.printed("f(1)") == "print(f(1))"


def test_pool_turns_sessions_and_tries():
    asked = []

    def client(name, faults):
        async def ask(messages, **settings):
            asked.append((name, settings))
            if faults:
                raise RuntimeError(faults.pop(0))
            return {"text": '{"note": 1} then {"score": 1.7}'}

        return ask

    pool = models.Pool([client("a", ["logprobs unsupported", "maximum context length is 1000 tokens, contains at least 900 input tokens"]), client("b", ["busy", "busy", "busy"])], wait=0.0)
    assert asyncio.run(models.judge(pool, "how good?", session="s", logprobs=True, top_logprobs=3)) == 1.0
    assert [n for n, _ in asked] == ["a"] * 3 and asked[1][1] == {"max_tokens": 8192} and asked[2][1] == {"max_tokens": 36}
    with pytest.raises(RuntimeError, match="busy"):
        pool.complete_now([])
    assert pool.client("s") is pool.clients[0] and models.score_of("none") == 0.0
    assert models.fewer_tokens("too long", 50) == 32 and models.fewer_tokens("maximum context length is 4096; contains at least 96 input tokens", 8000) == 3936


def test_search_and_chain():
    async def propose(node, rollout):
        return [("left", 0.4), ("right", 0.6)]

    async def execute(node):
        return f"saw {node.action}"

    async def assess(node):
        return 0.9 if node.action == "right" else 0.1

    root = asyncio.run(loops.Search(propose, execute, assess, rollouts=6, max_depth=3).run(loops.Node("r")))
    assert root.visits == sum(c.visits for c in root.children) > 0 and root.children[0].action == "right"
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo += n.children
    for n in nodes:
        under = [m.r_post for m in nodes if m.r_post is not None and n in m.path()]
        assert n.visits == len(under) and n.q == pytest.approx(sum(under) / max(len(under), 1))

    async def think(steps):
        return "t", {"code": "x"} if len(steps) < 2 else {"tool_name": "stop"}

    async def run(code):
        return code * 2

    steps = asyncio.run(loops.chain(think, run))
    assert [s[2] for s in steps] == ["xx", "This code was run before; try something else.", ""]


def test_feedback_repair_and_batch():
    async def make(reason, number):
        if number == 1:
            raise ValueError("first")
        return (reason, number)

    assert asyncio.run(loops.with_feedback(make, lambda x: None if x[1] == 3 else "short")) == ("short", 3)
    assert asyncio.run(loops.with_feedback(make, lambda x: "bad", tries=2)) is None
    trees = [{"nodes": [{"node_id": i, "logs": []}]} for i in range(3)]

    async def again(tree, leaf):
        return ["new"]

    out, n = asyncio.run(loops.repaired(trees, lambda t: t["nodes"][0], again, max_fixes=2))
    assert n == 2 and [t["nodes"][0]["logs"] for t in out] == [["new"], ["new"], []]
    assert asyncio.run(loops.repaired(trees, lambda t: t["nodes"][0], again, dry=True)) == (trees, 3)
    assert loops.batch(["b", "a", "c"], lambda d: int(d == "b"), stop_on_error=True) == {"a": 0, "b": 1}
