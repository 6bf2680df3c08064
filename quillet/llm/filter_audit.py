"""Filter interaction audit (operator 13): what each filter removes, first, last or alone, in every order.

Each document gets a mask of the filters that it fails, one bit a filter.  Masks
are counted per part (source); a part has at most 2^filters cells, whatever its
rows.  Each cell is then folded across the array of all orders with the SQL
functions ``aggregate`` and ``transform``: it gives one weighted struct per order and step,
and the structs of a part's cells are merged by elementwise sums (``zip_with``).  The
order array is a literal of the plan, so it travels to the tasks with it.

The filter of copies needs the whole table: a text is one if a smaller doc_id has
the same text.  Texts are compared by SHA-256.  Only narrow rows (hash, id, part, mask) are
shuffled; a hash that a third of all rows share is combined before the shuffle,
and the join on (hash, smallest id) has a key per row.

Edge cases: a null text is empty, a null source is the part ''; a null doc_id is
neither smaller nor larger than another, so its row is no copy and has no label;
rows of one doc_id with the same text are no copies of each other; of several labels of one
doc_id, any 1 counts; a document without a label is neither good nor toxic; an empty
table has no parts and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut

#: Failure conditions as SQL over _text, _words (its words) and _chars (its code points).
FILTERS: dict[str, str] = {
    "A": "size(_words) < 50",
    "B": "100 * size(array_distinct(_words)) < 65 * size(_words)",
    "C": "100 * regexp_count(_text, '[A-Z]') > 5 * _chars",
    "D": "_text rlike '[#$%&*|]'",
}
#: The filter of documents whose text a smaller doc_id has.
COPIES = "E"

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bits(letters: list[str]) -> dict[str, int]:
    if any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters) or len(letters) > 7:
        raise ValueError("filters have different names of one letter each, and there are at most seven")
    return {x: 1 << k for k, x in enumerate(letters)}


def masks(docs: DataFrame, filters: Mapping[str, str] = FILTERS, copies: str = COPIES) -> DataFrame:
    """(doc_id, part, mask) of every row: the sum of the bits of the filters that it fails, in the filters' order, ``copies`` last."""
    bits = _bits([*filters, copies])
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text")).withColumns(
        {"_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), "_chars": F.length("_text")}
    )
    own = sum((F.when(F.expr(test), bits[x]).otherwise(0) for x, test in filters.items()), start=F.lit(0))
    rows = cut(read.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("_text", 256)).alias("same")))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    known = rows.filter("doc_id is not null").join(first, ["same", "doc_id"], "left")
    judged = known.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(bits[copies])).alias("mask"))
    return judged.unionByName(rows.filter("doc_id is null").select("doc_id", "part", F.col("own").alias("mask")))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part with the same mask, those labelled quality 1 and toxic 1 among them."""
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic")
    )
    known = masked.filter("doc_id is not null").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    other = masked.filter("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(other).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _folded(letters: list[str]) -> Column:
    """The structs of all orders and steps, summed over ``cells`` (mask, n, good, toxic), each with its filter's removals in all orders."""
    orders = "array(" + ", ".join(f"'{''.join(o)}'" for o in permutations(letters)) + ")"
    bit = "element_at(map(" + ", ".join(f"'{x}', {b}" for x, b in _bits(letters).items()) + "), letter)"
    kind = "array<struct<filter_order: string, step: int, letter: string, " + ", ".join(f"{c}: bigint" for c in _COUNTS) + ">>"
    # One order of one cell: ``before`` holds the bits of the filters that came first.
    step = f"""
      transform(array({bit}), b -> named_struct('before', a.before | b, 'out', concat(a.out, array(named_struct(
        'filter_order', o, 'step', size(a.out) + 1, 'letter', letter,
        'kept', if(c.mask & (a.before | b) = 0, c.n, 0L),
        'removed', if(c.mask & a.before = 0 AND c.mask & b <> 0, c.n, 0L),
        'redundant', if(c.mask & a.before <> 0 AND c.mask & b <> 0, c.n, 0L),
        'unique_fails', if(c.mask = b, c.n, 0L),
        'good_lost', if(c.mask & a.before = 0 AND c.mask & b <> 0, c.good, 0L),
        'toxic_lost', if(c.mask & a.before = 0 AND c.mask & b <> 0, c.toxic, 0L))))))[0]"""
    cell = f"flatten(transform({orders}, o -> aggregate(split(o, ''), named_struct('before', 0, 'out', CAST(array() AS {kind})), (a, letter) -> {step}, a -> a.out)))"
    added = ", ".join(f"'{c}', x.{c} + y.{c}" for c in _COUNTS)
    merged = f"if(size(acc) = 0, one, zip_with(acc, one, (x, y) -> named_struct('filter_order', x.filter_order, 'step', x.step, 'letter', x.letter, {added})))"
    folded = f"aggregate(cells, CAST(array() AS {kind}), (acc, c) -> transform(array({cell}), one -> {merged})[0])"
    # ``all`` and ``sums`` are bound once as the only element of an array, lest they be made again for each of their uses.
    removed = ", ".join(f"'{x}', aggregate(all, 0L, (s, x) -> s + if(x.letter = '{x}', x.removed, 0L))" for x in letters)
    with_sums = f"transform(array(map({removed})), sums -> transform(all, x -> struct(x AS x, element_at(sums, x.letter) AS shapley)))[0]"
    return F.expr(f"transform(array({folded}), all -> {with_sums})[0]")


def interactions(counted: DataFrame, letters: list[str]) -> DataFrame:
    """The audit of ``counted`` cells: one row per part, order of ``letters`` and step."""
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^filters at most
    each = gathered.select("part", F.explode_outer(_folded(letters)).alias("e"))  # never empty; outer, lest a filter on its size make it twice
    return each.select("part", "e.x.filter_order", "e.x.step", *[f"e.x.{c}" for c in _COUNTS], "e.shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, copies: str = COPIES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(cells(masks(docs, filters, copies), labels), [*filters, copies])
