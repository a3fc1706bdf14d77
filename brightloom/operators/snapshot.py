"""Row writes as functions from one snapshot of a table to the next.

Defined results. Keys compare by equality, so a null key matches no row: it is never taken, never changed and never
replaced. Keys of insert_unique compare in lower case. Of changes with the same key the last in `order` wins, for patch field by
field; without `order` the one with the greatest values. A null predicate leaves a row as it is. Empty tables and empty changes give
what is there. Columns of the changes that the table lacks are ignored; order and fields_set are read from the changes alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import checkpointed

from .ranking import free, ranked


def insert(old: DataFrame, new: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Adds rows; defaults fill columns that the new rows lack or hold as null."""
    for name, value in (defaults or {}).items():
        new = new.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    return old.unionByName(new.select(*(F.col(c).cast(t) for c, t in old.dtypes)))


def _without(new: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys, in any case, is among those of `taken`."""
    name = free(new, "_taken")
    for k in keys:
        held = taken.select(F.lower(k).alias(name)).distinct()
        new = new.join(held, F.lower(k) == F.col(name), "left_anti")
    return new


def insert_unique(old: DataFrame, new: DataFrame, keys: list[str], order: str, folded: tuple[str, ...] = ()) -> DataFrame:
    """Adds the new rows as if one came after the other in `order`: a row is refused if any of its keys is held, in any case, by an
    old row or by a new one that was added before. Columns in `folded` are stored in lower case.

    With one key the first row of each value is added. With several, a row that is first in all its keys is added and what
    clashes with it refused, in rounds until all are decided; a round decides every row that no undecided one comes before.
    """
    new = _without(new, old, keys).withColumns({c: F.lower(c) for c in folded})
    first = lambda k, by: F.col(k).isNull() | (F.row_number().over(Window.partitionBy(F.lower(k)).orderBy(*by)) == 1)
    if len(keys) == 1:
        rest, mark = sorted(c for c in new.columns if c != order), free(new, "_first")
        return insert(old, new.withColumn(mark, first(keys[0], [order, *rest])).where(mark).drop(mark))
    row, marks = free(new, "_row"), [free(new, f"_first{i}") for i in range(len(keys))]
    left = checkpointed(new.withColumn(row, F.monotonically_increasing_id()))
    out = old
    while not left.isEmpty():
        added = checkpointed(left.withColumns({m: first(k, [order, row]) for m, k in zip(marks, keys, strict=True)}))
        for m in marks:
            added = added.where(m)
        out = insert(out, added)
        left = checkpointed(_without(left.join(added.select(row), row, "left_anti"), added, keys))
    return out


def _later(changes: DataFrame, key: str, order: str | None) -> list[Column]:
    return [F.col(order)] if order else [F.col(c) for c in sorted(changes.columns) if c not in (key, "fields_set")]


def _last(changes: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of rows with the same key the last; rows without one as they are."""
    by, n = [c.desc_nulls_last() for c in _later(changes, key, order)], free(changes, "_n")
    rest = [F.col(c).desc_nulls_last() for c in sorted(changes.columns) if c != key]
    return changes.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*by, *rest))).where(F.col(key).isNull() | (F.col(n) == 1)).drop(n)


def replace_by(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Delete-then-insert: one live row for each key among the new rows."""
    gone = free(old, "_key")
    return old.join(new.select(F.col(key).alias(gone)).distinct(), F.col(key) == F.col(gone), "left_anti").select(old.columns).unionByName(_last(new, key, order).select(old.columns))


def update(old: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    """Where the predicate is null, the row stays as it is."""
    return old.withColumns({c: F.when(match, v).otherwise(F.col(c)) for c, v in values.items()})


def _changed(old: DataFrame, changes: DataFrame, key: str, value: Callable[[str], Column], columns: list[str]) -> DataFrame:
    """One change for each key at most."""
    joined = old.alias("o").join(changes.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.select(*(value(c).alias(c) if c in columns else F.col(f"o.{c}") for c in old.columns))


def put(old: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Full update: all the columns named come from the change."""
    last = _last(changes.where(F.col(key).isNotNull()), key, order)
    return _changed(old, last, key, lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")), columns)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Partial update: columns listed in the change's fields_set, explicit nulls included. A null list sets nothing."""
    by = _later(changes, key, order)
    # for each column the value of the last change that sets it; the order comes first in the struct that is compared
    of = lambda c: F.max(F.when(F.array_contains("fields_set", c), F.struct(*[x.alias(f"by{i}") for i, x in enumerate(by)], F.col(c).alias("value")))).alias(c)
    sets = changes.where(F.col(key).isNotNull()).groupBy(key).agg(*map(of, columns))
    return _changed(old, sets, key, lambda c: F.when(F.col(f"n.{c}").isNotNull(), F.col(f"n.{c}.value")).otherwise(F.col(f"o.{c}")), columns)


def refused_changes(old: DataFrame, changes: DataFrame, key: str, unique: list[str], order: str) -> DataFrame:
    """(key, order) of the changes that would take a unique value from another row.

    A value counts only if the change sets it, it isn't null and it differs from the row's own in more than case. It is
    refused if another row of the table has it, in any case, or if an earlier change, of another row, asks for it.
    """
    out = None
    row, value, first = free(changes, "_key"), free(changes, "_new"), free(changes, "_ahead")
    mine = [free(changes, f"_own{i}") for i in range(len(unique))]
    own = old.select(F.col(key).alias(row), *[F.col(c).alias(m) for c, m in zip(unique, mine, strict=True)])
    asked = changes.join(own, F.col(key) == F.col(row))
    for c, m in zip(unique, mine, strict=True):
        new = F.lower(c)
        moved = asked.where(F.array_contains("fields_set", c) & F.col(c).isNotNull() & ~new.eqNullSafe(F.lower(m))).select(key, order, new.alias(value))
        held = moved.join(old.select(F.lower(c).alias(value)).distinct(), value, "left_semi").select(key, order)
        ahead = F.first(F.col(key)).over(Window.partitionBy(value).orderBy(order, key))
        late = moved.withColumn(first, ahead).where(F.col(first) != F.col(key)).select(key, order)
        out = held.union(late) if out is None else out.union(held).union(late)
    return out.distinct()


def patch_unique(old: DataFrame, changes: DataFrame, key: str, columns: list[str], unique: list[str], order: str) -> DataFrame:
    """Partial update without the changes that refused_changes names."""
    row, at = free(changes, "_key"), free(changes, "_order")
    refused = refused_changes(old, changes, key, unique, order).select(F.col(key).alias(row), F.col(order).alias(at))
    fit = changes.join(refused, (F.col(key) == F.col(row)) & F.col(order).eqNullSafe(F.col(at)), "left_anti")
    return patch(old, fit, key, columns, order)


def delete(old: DataFrame, match: Column) -> DataFrame:
    return old.where(~F.coalesce(match, F.lit(False)))


def delete_cascade(parents: DataFrame, gone: Column, key: str, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The parents that stay, and the children of those: for each child table its foreign key."""
    ids = parents.where(gone).select(F.col(key)).distinct()
    return delete(parents, gone), {n: c.join(ids.toDF(lost := free(c, "_gone")), F.col(fk) == F.col(lost), "left_anti") for n, (c, fk) in children.items()}


def outcomes(changes: DataFrame, old: DataFrame, key: str, owner: str, caller: str) -> DataFrame:
    """(key, status): 404 without the row, 403 for another's row, 200. A row without an owner is another's."""
    joined = changes.alias("c").join(old.alias("o"), F.col(f"c.{key}") == F.col(f"o.{key}"), "left")
    status = F.when(F.col(f"o.{key}").isNull(), 404).when(~F.col(f"o.{owner}").eqNullSafe(F.col(f"c.{caller}")), 403).otherwise(200)
    return joined.select(F.col(f"c.{key}").alias(key), status.alias("status"))


def next_ids(rows: DataFrame, start: int, bucket: Column, order: list[Column]) -> DataFrame:
    """Rows with ids after `start`, gapless in the order; buckets as for ranked()."""
    return ranked(rows, bucket, order, "id").withColumn("id", F.col("id") + start)
