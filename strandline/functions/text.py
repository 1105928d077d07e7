"""Column functions on tagged step text, answers and the facts in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags, their aliases, and the patterns of paths, extensions, counts and columns.
ALIASES = {
    "thought": "think", "reasoning": "think", "reflection": "think",
    "tool_result": "result", "feedback": "result", "observation": "result", "obs": "result", "r": "result",
    "final": "answer", "finalanswer": "answer", "final_answer": "answer",
}
CORE_TAGS = ("think", "result", "answer")
TOOL_TAGS = ("python", "search", "browser", "webbrowser", "webbrowseragent", "google", "bing", "retrieve", "calculator", "code", "bash", "sql", "codedebugger", "backtracer", "refiner")
SEARCH_TAGS = ("search", "browser", "webbrowser", "webbrowseragent", "google", "bing", "retrieve")
ERRORS = ("traceback", "exception", "error", "failed", "not found", "timeout", "syntaxerror", "nameerror", "typeerror", "valueerror", "maximum python call limit is exceeded")
PATH = r"""(?:[A-Za-z]:)?(?:[/\\][^\s<>'"`]+)+"""
FILE = r"\b[\w.\-]+\.[A-Za-z0-9]{1,8}\b"
EXTENSION = r"\.[A-Za-z0-9]{1,8}\b"
COUNT = r"(?i)\b(rows?|nrows?|records?|files?|directories|directory|dirs?|folders?|columns?|fields?)\b[^\n:]{0,24}[:= ]\s*([0-9]+)"
SHAPE = r"(?i)\bshape\b[^\n:]{0,24}[:= ]\s*\(?\s*([0-9]+)\s*,\s*([0-9]+)\s*\)?"
COUNT_LABELS = {
    "rows": "row_count", "row": "row_count", "nrows": "row_count", "row_count": "row_count", "records": "row_count", "record": "row_count",
    "files": "file_count", "file": "file_count", "file_count": "file_count",
    "directories": "dir_count", "directory": "dir_count", "dirs": "dir_count", "dir": "dir_count", "dir_count": "dir_count", "folders": "dir_count", "folder": "dir_count",
    "columns": "column_count", "column": "column_count", "fields": "column_count", "field": "column_count", "column_count": "column_count",
}
TAG = r"</?[A-Za-z_][A-Za-z0-9_-]*>"
#: Full-width ASCII, by rule, and what it stands for.
FULL_WIDTH, PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
UNCERTAIN = r"(?i)\b(uncertain|unsure|unable|not inspected|not available|could not|may contain|likely|appears to)\b"


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonical_tag(tag: Column) -> Column:
    """Lower-case tag name with aliases resolved."""
    return F.coalesce(F.element_at(literal_map(ALIASES), F.lower(tag)), F.lower(tag))


def rewrite_tags(text: Column) -> Column:
    """Every tag in lower case, aliases under their canonical names: the stretches between tags and the tags, put together again."""
    between, tags = F.split(text, TAG), F.regexp_extract_all(text, F.lit(TAG), 0)

    def canonical(tag: Column) -> Column:
        name = canonical_tag(F.regexp_extract(tag, r"([A-Za-z_][A-Za-z0-9_-]*)", 1))
        return F.concat(F.when(F.startswith(tag, F.lit("</")), "</").otherwise("<"), name, F.lit(">"))

    return F.array_join(F.zip_with(between, F.transform(tags, canonical), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def compat(text: Column) -> Column:
    """Full-width forms as plain ones, no-break spaces as spaces, the five named references decoded: what matters of NFKC in column expressions."""
    x = F.translate(text, FULL_WIDTH + "\u3000\u00a0", PLAIN + "  ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def folded(text: Column) -> Column:
    """``compat`` in lower case, with sharp s as two letters."""
    return F.replace(F.lower(compat(text)), F.lit("ß"), F.lit("ss"))


def paired_tags(text: Column, tag: str) -> Column:
    """How many openers of a tag have a closer: the lesser of both numbers."""
    return F.least(F.regexp_count(text, F.lit(f"<{tag}>")), F.regexp_count(text, F.lit(f"</{tag}>")))


def without_results(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<result>.*?</result>", "")


def outer_block(text: Column, tag: str) -> Column:
    """From the first opener of a tag to its last closer, trimmed; null if there is none."""
    return F.nullif(strip(F.regexp_extract(text, rf"(?s)<{tag}>.*</{tag}>", 0)), F.lit(""))


def outer_body(text: Column, tag: str) -> Column:
    """What ``outer_block`` holds, trimmed; null if there is no such block."""
    return F.when(outer_block(text, tag).isNotNull(), strip(F.regexp_extract(text, rf"(?s)<{tag}>(.*)</{tag}>", 1)))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[A-Za-z_][A-Za-z0-9_-]*>", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def last_answer(text: Column) -> Column:
    """A trailing unclosed answer, else the last closed one, else the text without think, python and result blocks."""
    closed = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    open_ = F.regexp_extract(text, r"(?s)<answer>((?:(?!</?answer>).)*)\z", 1)
    bare = F.regexp_replace(text, r"(?s)<(think|python|result)>.*?</\1>", "")
    return F.btrim(F.when(open_ != "", open_).when(F.size(closed) > 0, F.element_at(closed, -1)).otherwise(bare))


def last_boxed(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)\\boxed\{(.*?)\}"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def normal_answer(text: Column) -> Column:
    """The comparable core of an answer: answer body, boxed body, no markup, prefix or end punctuation, lower case."""
    x = F.coalesce(last_boxed(last_answer(text)), last_answer(text))
    x = F.regexp_replace(strip_tags(compat(x)), r"\$", " ")
    x = F.regexp_replace(x, r"\\(?:boxed|text)\{([^{}]*)\}", "$1")
    x = F.regexp_replace(squeeze(x), r"(?i)^(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)\s*:?\s*", "")
    return folded(F.btrim(squeeze(x), F.lit(".,;:!?\"'` ")))


def number(text: Column) -> Column:
    """A plain number or a fraction, commas ignored; else null."""
    x = F.btrim(F.replace(text, F.lit(","), F.lit("")))
    plain = F.when(x.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), F.expr("1").cast("double") * x.try_cast("double"))
    top, low = F.regexp_extract(x, r"^([-+]?[0-9]+)\s*/\s*([0-9]+)$", 1), F.regexp_extract(x, r"^([-+]?[0-9]+)\s*/\s*([0-9]+)$", 2)
    return F.coalesce(plain, F.try_divide(top.try_cast("double"), low.try_cast("double")))


def answers_match(prediction: Column, reference: Column) -> Column:
    """true, false, or null where either is blank."""
    p, r = normal_answer(prediction), normal_answer(reference)
    a, b = number(p), number(r)
    near = F.abs(a - b) <= 1e-8 * F.greatest(F.lit(1.0), F.abs(b))
    plain = lambda x: squeeze(F.regexp_replace(x, r"[^\w\s./-]", ""))
    blank = F.coalesce(p, F.lit("")).isin("") | F.coalesce(r, F.lit("")).isin("")
    return F.when(blank, F.lit(None).cast("boolean")).when(a.isNotNull() & b.isNotNull(), near).otherwise((p == r) | (plain(p) == plain(r)))


def path_token(token: Column) -> Column:
    """A path token without quotes, with forward slashes, without end punctuation, scheme or leading ./ characters."""
    x = F.replace(F.btrim(token, F.lit("'\"` ")), F.lit("\\"), F.lit("/"))
    x = F.regexp_replace(F.rtrim(x, F.lit(".,;:")), r"^file://", "")
    return F.ltrim(x, F.lit("./"))


def path_tokens(text: Column) -> Column:
    found = F.concat(F.regexp_extract_all(text, F.lit(PATH), 0), F.regexp_extract_all(text, F.lit(FILE), 0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, path_token), lambda x: x != "")))


def extension_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EXTENSION), 0), F.lower)))


def count_facts(text: Column) -> Column:
    """array<struct<label, value>> of counts and shapes stated in the text; unknown labels are dropped."""
    names, values = F.regexp_extract_all(text, F.lit(COUNT), 1), F.regexp_extract_all(text, F.lit(COUNT), 2)
    label = lambda x: F.element_at(literal_map(COUNT_LABELS), F.lower(x))
    said = F.zip_with(names, values, lambda n, v: F.struct(label(n).alias("label"), v.try_cast("bigint").alias("value")))
    shape = lambda group, name: F.transform(F.regexp_extract_all(text, F.lit(SHAPE), group), lambda v: F.struct(F.lit(name).alias("label"), v.try_cast("bigint").alias("value")))
    return F.filter(F.array_distinct(F.concat(said, shape(1, "row_count"), shape(2, "column_count"))), lambda x: x["label"].isNotNull())


def has_error(text: Column) -> Column:
    return folded(text).rlike("|".join(ERRORS))


def shorten_separators(text: Column) -> Column:
    """Runs of six or more = - or _ as three."""
    return F.regexp_replace(text, r"([=\-_])\1{5,}", "$1$1$1")


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters: head and tail around a mark, or the head alone if that is short."""
    if most < 80:
        return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)
    keep = (most - 20) // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("...<truncated>..."), F.right(text, F.lit(keep)))).otherwise(text)


def truncate_observation(text: Column, most: int = 6000, head: int = 4000, tail: int = 1500) -> Column:
    notice = F.concat(F.lit("\n...[truncated original_length="), F.length(text).cast("string"), F.lit(" dropped="), (F.length(text) - head - tail).cast("string"), F.lit("]...\n"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), notice, F.right(text, F.lit(tail)))).otherwise(text)
