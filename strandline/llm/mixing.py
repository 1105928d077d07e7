"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree of domains, languages and sources.  The token budget
goes down from the root: a node's budget is split among its children by
weight, no child getting more than its subtree can give (its tokens times
``epochs``).  What a child can't give goes to its siblings, and only what all
of them together can't give is missing at their parent, whose own siblings
then get it.  The split is exact: in each family, children are sorted by
capacity over weight, and the level at which the budget is used up follows
from running sums.

A leaf with budget b and t tokens gives every document b div t times, and in
the next epoch a prefix of b mod t tokens of its documents, in the order of a
hash of seed, epoch and id, then of the text's.  The place where the prefix
ends is found by sums over ranges of the hash, digit by digit, until the range
that holds it has few rows; equal rows, however many, are one sum.  That leaves
one row per leaf, by which every document decides for itself: no leaf is
sorted in one task, and the documents are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import durable, free_name, small_or_shuffled, text_or_empty

EPOCHS = 3
SEED = 17
#: Target weights of the production mix; a name not listed weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"web": 4, "books": 2, "code": 2, "talk": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
DEFAULT_WEIGHT = 1
#: Hexadecimal digits of the place by which ranges are cut at a time, digits that a place has, and rows of a range that is not cut again.
RANGE_DIGITS, PLACE_DIGITS, RANGE_ROWS = 2, 64, 10_000
LEVELS = ("domain", "lang", "source")
DOMAINS = tuple(DOMAIN_WEIGHTS)


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number that ends its name (none: the first domain), in turn."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    turn = F.pmod(F.when(number == "", F.lit(0)).otherwise(number.cast("bigint")), F.lit(len(DOMAINS)))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (turn + 1).cast("int"))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in weights.items()], F.lit(DEFAULT_WEIGHT)).cast("double") if weights else F.lit(float(DEFAULT_WEIGHT))


def split(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """``children`` (family, name, weight, capacity, given: the family's budget) with budget.

    Sorted by capacity over weight, the first ones are full as long as the
    level that fills them keeps within what is given.
    """
    children = children.withColumn("ratio", F.col("capacity") / F.col("weight"))
    before = W.partitionBy(*family).orderBy("ratio", name).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy(*family).orderBy("ratio", name).rowsBetween(W.currentRow, W.unboundedFollowing)
    x = children.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double")).withColumn("open", F.sum("weight").over(onward))
    x = x.withColumn("full", F.col("used") + F.col("ratio") * F.col("open") <= F.col("given"))
    # The first child that isn't full sets the level; the others stand after it.
    first = F.first(F.when(~F.col("full"), (F.col("given") - F.col("used")) / F.col("open")), True).over(
        W.partitionBy(*family).orderBy("ratio", name).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return x.withColumn("budget", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * first)).drop("ratio", "used", "open", "full")


def budgets(leaves: DataFrame, budget: int | None, epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """(domain, lang, source, tokens, budget bigint) of ``leaves`` (domain, lang, source, tokens). budget: None for all tokens there are."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    tops = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy("root"))
    tops = tops.withColumn("root", F.lit(0)).withColumn("given", total.cast("double") if budget is None else F.lit(float(budget)))
    tops = split(tops.withColumn("weight", _weight(F.col("domain"), domain_weights)), ["root"], "domain").select("domain", F.col("budget").alias("given"))
    langs = split(langs.join(tops, "domain").withColumn("weight", _weight(F.col("lang"), lang_weights)), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    out = split(leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), source_weights)), ["domain", "lang"], "source")
    return out.select(*LEVELS, "tokens", F.floor("budget").cast("bigint").alias("budget"))


class _Names:
    """Columns that are added to a table, under names that it doesn't have."""

    def __init__(self, docs: DataFrame):
        self.domain, self.lang, self.source, self.text_hash, self.place, self.row, self.rank, self.copies = (free_name(docs, f"_{n}") for n in ("domain", "lang", "source", "text_hash", "place", "row", "rank", "copies"))
        self.leaf = (self.domain, self.lang, self.source)


def _keyed(docs: DataFrame, n: _Names, domain: Column | None) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns({n.domain: domain_of(source) if domain is None else domain, n.lang: F.coalesce(F.col("lang").cast("string"), F.lit("")), n.source: source, n.text_hash: F.md5(text_or_empty())})


def _placed(rows: DataFrame, n: _Names, leaves: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the columns of their leaf and their place in the order of its epoch."""
    rows = rows.join(leaves.withColumnsRenamed(dict(zip(LEVELS, n.leaf, strict=True))), list(n.leaf))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.withColumn(n.place, F.concat(order, F.col(n.text_hash)))


def _ends(rows: DataFrame, n: _Names) -> DataFrame:
    """(leaf, last, some) of ``rows`` with ``rest``: rows placed before ``last`` are in the prefix, and ``some`` of those placed there. A leaf without is whole in it."""
    key = dict(zip(n.leaf, LEVELS, strict=True))
    rows = rows.select(*[F.col(k).alias(v) for k, v in key.items()], "rest", "n_tokens", F.col(n.place).alias("place"))
    digits, at = 0, None

    def inside() -> DataFrame:
        """The rows in the ranges found so far, with the sum before those."""
        if at is None:
            return rows.withColumn("before", F.lit(0).cast("bigint"))
        return rows.join(small_or_shuffled(at.select(*LEVELS, "before", F.col("cell").alias("start"))), list(LEVELS)).where(F.substring("place", 1, digits) == F.col("start"))

    def ending(rows: DataFrame, cell: Column) -> DataFrame:
        """Of each leaf the first cell in which its sum exceeds what is left."""
        cells = rows.groupBy(*LEVELS, cell.alias("cell")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("cell")) + F.col("before")
        over = cells.withColumn("upto", upto).where("upto > rest")
        first = over.groupBy(*LEVELS).agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("tokens")).alias("before"), "tokens", "n", "rest"), "cell").alias("f"))
        return durable(first.select(*LEVELS, "f.*"))

    while digits < PLACE_DIGITS and (at is None or (at.agg(F.max("n")).first()[0] or 0) > RANGE_ROWS):
        at = ending(inside(), F.substring("place", 1, digits + RANGE_DIGITS))
        digits += RANGE_DIGITS
    last = at if digits >= PLACE_DIGITS else ending(inside(), F.col("place"))
    # Rows of one place are alike: so many of them fit.
    some = F.when(F.col("tokens") > 0, F.expr("(rest - before) div (tokens div n)")).otherwise(F.lit(0))
    return last.select(*LEVELS, F.col("cell").alias("last"), some.cast("bigint").alias("some"))


def _decided(docs: DataFrame, n: _Names, leaves: DataFrame, seed: int) -> DataFrame:
    """``docs`` (keyed) with how often each row is read; leaves: (leaf, whole, last, some)."""
    rows = _placed(docs, n, small_or_shuffled(leaves), seed)
    more = F.col("last").isNull() | (F.col(n.place) < F.col("last"))
    drawn = F.coalesce((F.col(n.place) == F.col("last")) & (F.col("some") > 0), F.lit(False))
    sure = rows.where(~drawn).withColumn(n.copies, F.col("whole") + more.cast("bigint"))
    if not leaves.where("some > 0").isEmpty():
        # Of rows that are all alike some are in the prefix: they are numbered by input partition.
        alike = durable(rows.where(drawn).withColumn(n.row, F.monotonically_increasing_id()))
        part = F.shiftright(n.row, 33)
        counts = alike.groupBy(*n.leaf, part.alias("part")).agg(F.count("*").alias("held"))
        first = F.coalesce(F.sum("held").over(W.partitionBy(*n.leaf).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = durable(counts.withColumn("first", first).drop("held"))
        own = F.row_number().over(W.partitionBy(*n.leaf, "part").orderBy(n.row))
        alike = alike.withColumn("part", part).join(small_or_shuffled(counts), [*n.leaf, "part"]).withColumn(n.rank, own + F.col("first"))
        alike = alike.withColumn(n.copies, F.col("whole") + (F.col(n.rank) <= F.col("some")).cast("bigint"))
        sure = sure.unionByName(alike.select(*sure.columns))
    return sure.where(F.col(n.copies) > 0)


def _leaves(keyed: DataFrame, n: _Names, budget: int | None, epochs: int, seed: int, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """(rows without their texts, (leaf, whole, last, some) of each leaf)."""
    rows = durable(keyed.select("doc_id", *n.leaf, n.text_hash, count_words(text_or_empty()).alias("n_tokens")))
    leaves = durable(rows.groupBy(*[F.col(k).alias(v) for k, v in zip(n.leaf, LEVELS, strict=True)]).agg(F.sum("n_tokens").alias("tokens")))
    shares = durable(budgets(leaves, budget, epochs, domain_weights, lang_weights, source_weights or {}))
    whole = F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0))
    shares = durable(shares.select(*LEVELS, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")))
    ends = _ends(_placed(rows, n, small_or_shuffled(shares), seed), n)
    return rows, durable(shares.drop("rest").join(ends, list(LEVELS), "left"))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    lang_weights: dict[str, int] = LANG_WEIGHTS,
    source_weights: dict[str, int] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """One row per chosen row of ``docs``: doc_id, domain, lang, source, n_tokens, copies (1 or more).

    Null lang or source counts as ''; a null doc_id is like the id ''.  Null
    and empty texts have no tokens and are chosen where their place in the
    epoch's order falls within the prefix.  Whole documents only, very long
    ones too: a prefix ends before the document that would exceed it, so no
    leaf exceeds its budget.  Ties in the order are rows with one id and
    text; any of them are taken, as many as fit.  Repeated rows count each on
    its own.  An empty table gives no rows.  Columns of ``docs`` other than
    doc_id, text, lang and source are not read, whatever their names.
    """
    docs = docs.select("doc_id", "text", "lang", "source") if domain is None else docs
    n = _Names(docs)
    rows, leaves = _leaves(_keyed(docs, n, domain), n, budget, epochs, seed, domain_weights, lang_weights, source_weights)
    out = _decided(rows, n, leaves, seed)
    return out.select("doc_id", *[F.col(k).alias(v) for k, v in zip(n.leaf, LEVELS, strict=True)], "n_tokens", F.col(n.copies).alias("copies"))


def mixed(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` chooses, with its columns, each as often as it is to be read.

    Cases are as in ``mix``: each row is decided on its own, also where rows
    share an id or have none; columns keep their names, whatever those are.
    """
    n = _Names(docs)
    keyed = _keyed(docs, n, domain)
    _, leaves = _leaves(keyed, n, budget, epochs, seed, domain_weights, lang_weights, source_weights)
    clash = {c: free_name(docs, f"_{c}_") for c in ("whole", "last", "some", "first", "part") if c in {x.lower() for x in docs.columns}}
    kept = [clash.get(c.lower(), c) for c in docs.columns]
    taken = _decided(keyed.withColumnsRenamed({c: clash[c.lower()] for c in docs.columns if c.lower() in clash}), n, leaves, seed)
    taken = taken.withColumn(n.rank, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n.copies))))
    return taken.select(*[F.col(f"`{k}`").alias(c) for k, c in zip(kept, docs.columns, strict=True)])
