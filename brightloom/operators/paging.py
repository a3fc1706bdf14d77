"""Pages of a table with the related row attached.

Defined results: an order that ends in a unique key gives each row one page; nulls sort as Spark has them (last when
descending). A page beyond the end is empty, an empty table has empty pages. A row whose key is null, or has no related
row, keeps nulls in the related columns. Columns of the two sides must differ in name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 10) -> DataFrame:
    """The order must end in a unique key. Sort, offset and limit become one TakeOrderedAndProject."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip >= 0 and 1 <= limit <= 100")
    return rows.orderBy(*order).offset(skip).limit(limit)


def keyset_page(rows: DataFrame, stamp: str, key: str, after: tuple | None, limit: int = 10) -> DataFrame:
    """The page after the last row seen, newest first. Its cost doesn't grow with the page's number."""
    if after is not None:
        ts, k = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(stamp) < ts) | (F.col(stamp) == ts) & (F.col(key) < k))
    return rows.orderBy(F.desc(stamp), F.desc(key)).limit(limit)


def with_related(paged: DataFrame, related: DataFrame, left: str, right: str) -> DataFrame:
    """Attaches to a page of at most 100 rows the related row of each; `right` is unique. The page is fetched first and its keys
    go into the second scan as a filter, so the related table is neither shuffled nor read beyond what the keys select."""
    rows = paged.take(101)
    if len(rows) > 100:
        raise ValueError("a page has at most 100 rows")
    keys = sorted({r[left] for r in rows if r[left] is not None})
    found = related.where(F.col(right).isin(keys))
    page_rows = paged.sparkSession.createDataFrame(rows, paged.schema)
    return page_rows.join(F.broadcast(found), F.col(left) == F.col(right), "left")  # a row for each key, 100 at most


def envelope(rows: DataFrame, skip: int, limit: int) -> DataFrame:
    """(total, skip, limit, returned, has_more)."""
    total = F.count("*")
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), total - skip))
    return rows.agg(total.alias("total"), F.lit(skip).alias("skip"), F.lit(limit).alias("limit"), returned.cast("long").alias("returned"), (F.lit(skip) + returned < total).alias("has_more"))


def response(rows: DataFrame, order: list[Column], related: DataFrame, left: str, right: str, item: list[Column], author: list[Column], skip: int = 0, limit: int = 10) -> DataFrame:
    """One row (posts, total, skip, limit, has_more): the page as an array in its order, each item a struct of `item` and of
    author, a struct of `author` over the related row (null where there is none). Beyond the end the array is empty.

    Only the page's rows are brought together; the total is one count."""
    some = page(rows, order, skip, limit)
    taken = some.collect()  # `limit` rows, 100 at most
    session, at = rows.sparkSession, "position" + "_" * max(map(len, [*rows.columns, *related.columns]))
    placed = session.createDataFrame([(i, *r) for i, r in enumerate(taken)], f"{at} int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema))
    joined = with_related(placed, related, left, right)
    of = F.when(F.col(right).isNotNull(), F.struct(*author)).alias("author")
    one = F.struct(F.col(at), F.struct(*item, of).alias("item"))
    posts = joined.agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["item"]).alias("posts"))
    numbers = envelope(rows, skip, limit).select("total", "skip", "limit", "has_more")
    return posts.join(F.broadcast(numbers), F.lit(True))  # one row each
