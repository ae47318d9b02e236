"""A sorted list as an array column: adding, removing, searching and slicing.

Arrays are taken to be sorted ascending; every function returns a sorted array or a
number.  Null arrays give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, x) -> Column:
    return F.array_sort(F.array_append(a, F.lit(x)))


def update(a: Column, other: Column) -> Column:
    return F.array_sort(F.concat(a, other))


def bisect_left(a: Column, x) -> Column:
    """Number of elements below x."""
    return F.size(F.filter(a, lambda v: v < x)).cast("bigint")


def bisect_right(a: Column, x) -> Column:
    """Number of elements up to x."""
    return F.size(F.filter(a, lambda v: v <= x)).cast("bigint")


def count(a: Column, x) -> Column:
    return F.size(F.filter(a, lambda v: v == x)).cast("bigint")


def index(a: Column, x) -> Column:
    """Place of the first x from 0; null if there is none."""
    return F.nullif(F.array_position(a, F.lit(x)), F.lit(0)) - 1


def discard(a: Column, x) -> Column:
    """Without one x; unchanged if there is none."""
    at = F.array_position(a, F.lit(x)).cast("int")
    return F.when(at > 0, F.concat(F.slice(a, 1, at - 1), F.slice(a, at + 1, F.size(a)))).otherwise(a)


def getitem(a: Column, i: int) -> Column:
    """Element i from 0, negative from the end; null beyond."""
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def pop(a: Column, i: int = -1) -> Column:
    """Without element i."""
    at = F.lit(i + 1) if i >= 0 else F.size(a) + i + 1
    return F.when((at >= 1) & (at <= F.size(a)), F.concat(F.slice(a, 1, F.greatest(at - 1, F.lit(0))), F.slice(a, at + 1, F.size(a)))).otherwise(a)


def islice(a: Column, start: int, stop: int) -> Column:
    return F.slice(a, start + 1, max(0, stop - start))


def irange(a: Column, low, high, inclusive: tuple[bool, bool] = (True, True)) -> Column:
    """Elements between two bounds, each with or without the bound itself."""
    return F.filter(a, lambda v: (v >= low if inclusive[0] else v > low) & (v <= high if inclusive[1] else v < high))


def backwards(a: Column) -> Column:
    return F.reverse(a)


def repeat(a: Column, n: int) -> Column:
    return F.array_sort(F.flatten(F.array_repeat(a, n)))


def sort_by_key(a: Column, key) -> Column:
    """Sorted by ``key(element)``, equal keys by the element."""
    return F.transform(F.array_sort(F.transform(a, lambda v: F.struct(key(v).alias("k"), v.alias("v")))), lambda s: s["v"])


def setitem(a: Column, i: int, x) -> Column:
    """With x in place of element i (from 0, negative from the end); null where that would not be sorted or i is beyond."""
    at = F.lit(i + 1) if i >= 0 else F.size(a) + i + 1
    put = F.transform(a, lambda v, k: F.when(k == at - 1, F.lit(x)).otherwise(v))
    return F.when((at >= 1) & (at <= F.size(a)) & (put == F.array_sort(put)), put)


def insert(a: Column, i: int, x) -> Column:
    """With x before element i (from 0, at most the size); null where that would not be sorted."""
    at = F.least(F.lit(i), F.size(a))
    put = F.concat(F.slice(a, F.lit(1), at), F.array(F.lit(x)).cast("array<bigint>"), F.slice(a, at + 1, F.size(a)))
    return F.when(put == F.array_sort(put), put)


def extend(a: Column, other: Column) -> Column:
    """With the elements of ``other`` behind; null where that would not be sorted."""
    put = F.concat(a, other)
    return F.when(put == F.array_sort(put), put)


def compare(a: Column, other: Column) -> Column:
    """-1, 0 or 1: whether a comes before, equals or comes after ``other``, element by element."""
    return F.when(a < other, -1).when(a == other, 0).when(a > other, 1).cast("bigint")


def bisect_key_left(a: Column, k, key) -> Column:
    """Number of elements whose key is below k."""
    return F.size(F.filter(a, lambda v: key(v) < k)).cast("bigint")


def bisect_key_right(a: Column, k, key) -> Column:
    """Number of elements whose key is at most k."""
    return F.size(F.filter(a, lambda v: key(v) <= k)).cast("bigint")


def irange_key(a: Column, low, high, key, inclusive: tuple[bool, bool] = (True, True)) -> Column:
    """Elements whose keys lie between two bounds, each with or without the bound itself, in order of their keys."""
    inside = F.filter(a, lambda v: (key(v) >= low if inclusive[0] else key(v) > low) & (key(v) <= high if inclusive[1] else key(v) < high))
    return sort_by_key(inside, key)
