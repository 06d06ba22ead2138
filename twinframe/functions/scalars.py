"""Column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that stands for a missing category.
MISSING = "__MISSING__"


def null_sentinels(column: Column, sentinels: Sequence[str] = ("?", "", "unknown"), strip: str | None = ".") -> Column:
    """Trimmed text; sentinel words become null; trailing ``strip`` characters are removed."""
    text = F.trim(column.cast("string"))
    cleaned = F.rtrim(text, F.lit(strip)) if strip else text
    return F.when(text.isin(*sentinels), F.lit(None).cast("string")).otherwise(cleaned)


def zero_as_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def recode(column: Column, labels: Mapping) -> Column:
    """Look a code up in a small map; an unmapped code becomes null."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def threshold_label(column: Column, bound: float, above: str, otherwise: str) -> Column:
    return F.when(column > bound, F.lit(above)).otherwise(F.lit(otherwise))


def coerce_numeric(column: Column) -> Column:
    """Text to double; unreadable text becomes null."""
    return column.try_cast("double")


def collapse_one_hot(columns: Sequence[str], template: str) -> Column:
    """Position of the first largest indicator (from 1), written with ``template``."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return F.format_string(template, F.array_position(values, F.array_max(values)).cast("bigint"))


def band(column: Column, cuts: Sequence[float], labels: Sequence[str], *, right_closed: bool = True) -> Column:
    """Cut a number into labelled bands; null stays null."""
    out = F.when(column.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(column <= cut if right_closed else column < cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def category_key(column: Column) -> Column:
    """Text key of a categorical value; null becomes the missing key."""
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def cardinality_bucket(distinct: Column) -> Column:
    return F.when(distinct <= 2, "binary").when(distinct <= 10, "low").when(distinct <= 50, "medium").otherwise("high")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null when the bottom is null or zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def safe_mean(value: Column) -> Column:
    """Mean of the numbers that are there, not counting NaN; null when there is none."""
    number = value.cast("double")
    return F.avg(F.when(~F.isnan(number), number))


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; edges belong to the bin on their right, the last bin is closed."""
    width = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((value - low) / (high - low) * F.lit(float(bins))).cast("bigint"), F.lit(bins - 1))
    lower = F.when(value < low + guess.cast("double") * width, guess - 1).otherwise(guess)
    upper = (lower + 1).cast("double") * width + low
    return F.when((value >= upper) & (lower < bins - 1), lower + 1).otherwise(lower)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def argmin(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("bigint")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(values: Column) -> Column:
    """Divide by the sum; a zero sum divides by one."""
    share = lambda v, total: F.transform(v, lambda x: x / F.when(total == 0, F.lit(1.0)).otherwise(total))
    return bind(values, lambda v: bind(array_sum(v), lambda total: share(v, total)))
