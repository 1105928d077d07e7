"""Parsers that no built-in expresses: Python code, lenient JSON, nested facts, NFKC. Arrow-batched UDFs, nulls as empty text."""

from __future__ import annotations

import ast
import html
import json
import re
import unicodedata
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from strandline.functions import text as T

#: Call names and their operation (the first that fits counts), suffixes of tables, patterns.
OPERATIONS = (
    (r"walk", "walk"),
    (r"(listdir|iterdir)$", "listdir"),
    (r"glob$", "glob"),
    (r"read_(csv|table|excel)", "read_table"),
    (r"read_json", "read_json"),
    (r"read_parquet", "read_parquet"),
    (r"^open$", "open_file"),
    (r"dump|write|to_json|to_csv", "write_file"),
    (r"head|sample", "sample_rows"),
)
TABLE_SUFFIXES = (".csv", ".tsv", ".json", ".jsonl", ".parquet")
FENCE = r"```(?:json)?\s*(.*?)```"
MAX_DEPTH, MAX_ITEMS = 4, 20
COLUMN_LIST = r"(?i)\b(?:columns?|schema|fields?)\b[^\n:]{0,12}[:= ]\s*(\[[^\]]{1,500}\])"
QUOTED = r"""["']([^"']{1,200})["']"""

# Types as objects: a DDL string could only be read with a session, and this module is imported before there is one.
STRINGS = ArrayType(StringType())
SPECIAL = re.compile(r"<(/?)(" + "|".join(sorted({*T.CORE_TAGS, *T.TOOL_TAGS, *T.ALIASES}, key=len, reverse=True)) + r")>", re.I)
BLOCKS = StructType([StructField("blocks", ArrayType(StructType([StructField("tag", StringType()), StructField("content", StringType())]))), StructField("faults", STRINGS)])
SIGNATURES = StructType([StructField("strict", StringType()), StructField("loose", StringType())])
ACTION = StructType([StructField("thought", StringType()), StructField("tool_name", StringType()), StructField("code", StringType()), StructField("parameters", StringType())])
CANDIDATES = ArrayType(StructType([StructField("action_type", StringType()), StructField("text", StringType()), StructField("score", DoubleType())]))
ACCESS = StructType([StructField("operations", STRINGS), StructField("literals", STRINGS)])
FACT = StructType([StructField(n, StringType()) for n in ("kind", "label", "value")])


def plain(s: str | None) -> str:
    """NFKC, character references decoded, white space runs as one space, trimmed."""
    return " ".join(html.unescape(unicodedata.normalize("NFKC", s or "")).split())


@F.pandas_udf(StringType())
def normalize_free_text(s: pd.Series) -> pd.Series:
    return s.map(plain)


def lenient(s: str | None) -> object:
    """The first of the text and its fenced blocks that reads as a JSON or Python list or object, else None."""
    for piece in (s or "", *re.findall(FENCE, s or "", re.S | re.I)):
        piece = piece.strip()
        if piece[:1] in ("[", "{"):
            for read in (json.loads, ast.literal_eval):
                try:
                    return read(piece)
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    pass
    return None


@F.pandas_udf(StringType())
def json_candidate(s: pd.Series) -> pd.Series:
    """The candidate as JSON text; null if there is none."""
    return s.map(lambda x: None if (v := lenient(x)) is None else json.dumps(v, default=str))


def balanced(s: str | None, opener: str) -> str | None:
    """The first balanced object or array from ``opener`` on, brackets in strings not counted; None if it never closes."""
    s = s or ""
    closer, start = {"{": "}", "[": "]"}[opener], s.find(opener)
    depth = 0
    for m in re.finditer(rf'"(?:\\.|[^"\\])*"?|{re.escape(opener)}|{re.escape(closer)}', s[start:], re.S) if start >= 0 else ():
        depth += {opener: 1, closer: -1}.get(m[0], 0)
        if depth == 0:
            return s[start : start + m.end()]
    return None


@F.pandas_udf(StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    return s.map(lambda x: balanced(x, "{"))


@F.pandas_udf(StringType())
def first_json_array(s: pd.Series) -> pd.Series:
    return s.map(lambda x: balanced(x, "["))


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of a chain of attributes; what isn't a name in it is left out."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, *([node.id] if isinstance(node, ast.Name) else [])]))


def python_calls(code: str | None) -> tuple[list[str], list[str]] | None:
    """(call names in lower case, string arguments) of a program; None if it doesn't parse."""
    try:
        calls = [n for n in ast.walk(ast.parse(code or "")) if isinstance(n, ast.Call)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    values = (a for c in calls for a in (*c.args, *(k.value for k in c.keywords)))
    return [dotted(c.func).lower() for c in calls], [a.value for a in values if isinstance(a, ast.Constant) and isinstance(a.value, str)]


@F.pandas_udf(ACCESS)
def _python_accesses(s: pd.Series) -> pd.DataFrame:
    def one(code: str | None) -> tuple[list[str], list[str]]:
        found = python_calls(code)
        if found is None:
            return ["execute_code"], []
        kinds = {next((op for p, op in OPERATIONS if re.search(p, name)), None) for name in found[0]} - {None}
        return sorted(kinds or {"execute_code"}), found[1]

    return pd.DataFrame([one(x) for x in s], columns=["operations", "literals"])


def python_accesses(code: Column) -> Column:
    """struct<operations, paths, primary_path> of a program.

    Paths are its path tokens and, where it parses, all string arguments of
    calls; the primary one is the first of a table, else the first.
    """
    x = _python_accesses(code)
    paths = F.array_sort(F.array_distinct(F.filter(F.concat(T.path_tokens(F.coalesce(code, F.lit(""))), F.transform(x["literals"], T.path_token)), lambda p: p != "")))
    suffix = r"(?i)[^/](" + "|".join(s.replace(".", r"\.") for s in TABLE_SUFFIXES) + ")$"
    first = F.coalesce(F.get(F.filter(paths, lambda p: p.rlike(suffix)), F.lit(0)), F.get(paths, F.lit(0)))
    return F.struct(x["operations"].alias("operations"), paths.alias("paths"), first.alias("primary_path"))


def nested_facts(value: object) -> Iterator[tuple[str, str | None, str]]:
    """(kind, label, value) of counts, columns and plain strings in nested data, in their order.

    Counts are numbers under a count's name, columns the strings of a list
    whose key names columns; data deeper than four levels and list items
    after the twentieth are not looked at.
    """
    todo = [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if isinstance(v, str):
            yield "text", None, v
        below: list[tuple[object, int]] = []
        if isinstance(v, dict):
            for key, item in v.items():
                name = plain(str(key)).casefold()
                if (label := T.COUNT_LABELS.get(name)) and isinstance(item, (int, float)):
                    if item == item and abs(item) != float("inf"):
                        yield "count", label, str(int(item))
                elif isinstance(item, list) and re.search("column|schema|field", name):
                    yield from (("column", None, x.strip()) for x in item if isinstance(x, str) and x.strip())
                else:
                    below.append((item, depth + 1))
        elif isinstance(v, list):
            below = [(x, depth + 1) for x in v[:MAX_ITEMS]]
        todo += [x for x in reversed(below) if x[1] <= MAX_DEPTH]


@F.pandas_udf(ArrayType(FACT))
def _structured(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"kind": k, "label": n, "value": v} for k, n, v in nested_facts(lenient(x))])


def structured_facts(text: Column) -> Column:
    """array<struct<kind, label, value>>, distinct: counts and columns of the JSON in the text, and paths and extensions of its strings."""
    raw = _structured(text)
    made = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("label"), v.alias("value")))
    said = lambda f: F.concat(made("path", T.path_tokens(f["value"])), made("extension", T.extension_tokens(f["value"])))
    return F.array_distinct(F.flatten(F.transform(raw, lambda f: F.when(f["kind"] == "text", said(f)).otherwise(F.array(f)))))


@F.pandas_udf(STRINGS)
def column_tokens(s: pd.Series) -> pd.Series:
    """Names in bracketed lists after columns, schema or fields, sorted."""

    def names(text: str | None) -> list[str]:
        found: set[str] = set()
        for raw in re.findall(COLUMN_LIST, text or ""):
            items = lenient(raw)
            found |= {x.strip() for x in (items if isinstance(items, list) else re.findall(QUOTED, raw)) if isinstance(x, str) and x.strip()}
        return sorted(found)

    return s.map(names)


def facts(text: Column) -> Column:
    """All facts a text states (kind, label, value), distinct: paths, extensions, counts, columns, and those of its JSON."""
    none = F.lit(None).cast("string")
    made = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), none.alias("label"), v.alias("value")))
    x = F.coalesce(text, F.lit(""))
    counts = F.transform(T.count_facts(x), lambda c: F.struct(F.lit("count").alias("kind"), c["label"].alias("label"), c["value"].cast("string").alias("value")))
    return F.array_distinct(F.concat(made("path", T.path_tokens(x)), made("extension", T.extension_tokens(x)), counts, made("column", column_tokens(x)), structured_facts(x)))


def strict_blocks(text: str | None) -> tuple[list[tuple[str, str]], list[str]]:
    """(top-level blocks, faults) of tagged text in which tags nest and every closer ends the innermost open one.

    Within an answer only its closer counts.  Faults name text outside of
    blocks, closers without opener or of another tag, and tags left open.
    """
    text = text or ""
    blocks, faults, open_ = [], [], []
    body = end = 0
    for m in SPECIAL.finditer(text):
        tag = m[2].lower()
        tag, closer = T.ALIASES.get(tag, tag), m[1] == "/"
        if open_[-1:] == ["answer"] and (tag, closer) != ("answer", True):
            continue
        if closer and not open_:
            faults.append(f"stray_closer:{tag}")
            end = m.end()
        elif closer:
            top = open_.pop()
            if top != tag:
                faults.append(f"mismatch:{top}:{tag}")
            if not open_:
                blocks.append((top, text[body : m.start()]))
                end = m.end()
        else:
            if not open_:
                body = m.end()
                if not text[end : m.start()].isspace() and end < m.start():
                    faults.append("outside_text")
            open_.append(tag)
    if open_:
        faults.append("unclosed:" + ",".join(open_))
    if text[end:].strip():
        faults.append("trailing_text")
    return blocks, list(dict.fromkeys(faults))


@F.pandas_udf(BLOCKS)
def parse_strict(s: pd.Series) -> pd.DataFrame:
    """struct<blocks: array<struct<tag, content>>, faults: array<string>> of ``strict_blocks``."""
    found = [strict_blocks(x) for x in s]
    return pd.DataFrame({"blocks": [[{"tag": t, "content": c} for t, c in b] for b, _ in found], "faults": [f for _, f in found]})


def signatures_of(tag: str | None, body: str | None) -> tuple[str, str]:
    """Signatures by which tool calls are the same, and nearly the same."""
    whole, line = html.unescape(unicodedata.normalize("NFKC", body or "")).strip(), plain(body)
    if tag in T.SEARCH_TAGS:
        strict = " ".join(whole.split()).casefold()
    else:
        strict = "\n".join(re.sub(r"[ \t]+", " ", x.strip()) for x in whole.splitlines() if x.strip())
    if tag == "python":
        loose = " ".join(re.sub(r"\b[0-9]+(?:\.[0-9]+)?\b", "__NUM__", re.sub(r"([\"']).*?\1", "__STR__", line)).split())
    else:
        loose = line.casefold()
    return f"{tag}:{strict}", f"{tag}:{loose[:4000]}"


@F.pandas_udf(SIGNATURES)
def signatures(tag: pd.Series, body: pd.Series) -> pd.DataFrame:
    """struct<strict, loose> of tool calls."""
    return pd.DataFrame([signatures_of(t, b) for t, b in zip(tag, body, strict=True)], columns=["strict", "loose"])


def action_object(text: str | None) -> dict | None:
    """The first JSON object of an action, in a fence or not, trailing commas forgiven; None if it doesn't read as one."""
    text = (text or "").strip()
    if fence := re.search(FENCE, text, re.S):
        text = fence[1].strip()
    raw = balanced(text, "{") or text[max(text.find("{"), 0) :]
    for attempt in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


@F.pandas_udf(ACTION)
def react_action(s: pd.Series) -> pd.DataFrame:
    """struct<thought, tool_name, code, parameters> of a reply in the form "Thought: ... Action: {...}"; the last three are null without a valid action."""

    def one(text: str | None) -> tuple:
        thought = re.search(r"Thought:\s*(.*?)(?=\nAction:|\Z)", text or "", re.S)
        action = re.search(r"Action:\s*(.*)", text or "", re.S)
        found = action_object(action[1]) if action else None
        said = thought[1].strip() if thought else ""
        return (said, None, None, None) if found is None else (said, _text(found.get("tool_name", "")), _text(found.get("code", "")), None)

    return pd.DataFrame([one(x) for x in s], columns=["thought", "tool_name", "code", "parameters"])


@F.pandas_udf(ACTION)
def xml_action(s: pd.Series) -> pd.DataFrame:
    """struct<thought, tool_name, code, parameters> of a reply in XML, in a <response> or not; parameters is JSON, {} where it doesn't read. An ill-formed response is an error."""

    def one(text: str | None) -> tuple:
        text = text or ""
        response = re.search(r"<response\b[^>]*>.*?</response>", text, re.S)
        if response:
            root = ElementTree.fromstring(response[0])
            inner = root.find("action")
            get = lambda node, *names: next((v.strip() for n in names if (v := node.findtext(n))), "")
            holder = root if inner is None else inner
            thought, tool, params = get(root, "thought", "intent"), get(holder, "tool_name"), get(holder, "parameters")
        else:
            find = lambda *names: next((m[1].strip() for n in names if (m := re.search(rf"<{n}\b[^>]*>(.*?)</{n}>", text, re.S)) and m[1].strip()), "")
            thought, tool, params = find("thought", "intent"), find("tool_name"), find("parameters")
        try:
            params = json.dumps(json.loads(params)) if params else "{}"
        except ValueError:
            params = "{}"
        return thought, tool, None, params

    return pd.DataFrame([one(x) for x in s], columns=["thought", "tool_name", "code", "parameters"])


def candidates(text: Column, types: tuple[str, ...], field: str, score: str, most: int) -> Column:
    """array<struct<action_type, text, score>>: up to ``most`` objects of the first JSON array of a reply that have a non-blank ``field``; a type that isn't allowed becomes the first one, a score is within 0 and 1."""

    @F.pandas_udf(CANDIDATES)
    def run(s: pd.Series) -> pd.Series:
        def one(reply: str | None) -> list[dict]:
            rows = lenient(balanced(re.sub(r"(?s)<think>.*?</think>", "", reply or ""), "["))
            out = []
            for x in rows if isinstance(rows, list) else ():
                body = _text(x.get(field)).strip() if isinstance(x, dict) else ""
                if body and len(out) < most:
                    kind = _text(x.get("action_type")).strip()
                    try:
                        value = float(x.get(score, 0.0))
                    except (TypeError, ValueError):
                        value = 0.0
                    out.append({"action_type": kind if kind in types or not types else types[0], "text": body, "score": min(max(value, 0.0), 1.0)})
            return out

        return s.map(one)

    return run(text)
