"""Nested pages and checked bodies against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from brightloom.operators import paging, validation


def test_nested_pages(spark):
    posts = spark.createDataFrame([(i, f"t{i}", 7 if i % 2 else (None if i == 2 else 9), i % 5) for i in range(23)], "id int, title string, user_id int, position int").repartition(3)
    authors = spark.createDataFrame([(7, "ann", None), (8, "bo", "b.jpg")], "aid int, name string, image string")
    item, author = [F.col("id"), F.col("title")], [F.col("aid").alias("id"), F.col("name"), F.col("image")]
    for skip, limit in ((0, 10), (20, 10), (0, 23), (40, 5)):
        got = paging.response(posts, [F.desc("id")], authors, "user_id", "aid", item, author, skip, limit)
        assert got.columns == ["posts", "total", "skip", "limit", "has_more"]
        r = got.first()
        want = [(i, f"t{i}", (7, "ann", None) if i % 2 else None) for i in range(22, -1, -1)][skip : skip + limit]
        assert [(x["id"], x["title"], x["author"] and tuple(x["author"])) for x in r["posts"]] == want
        assert tuple(r)[1:] == (23, skip, limit, skip + len(want) < 23 and skip < 23)
    assert tuple(paging.response(posts.limit(0), [F.desc("id")], authors, "user_id", "aid", item, author).first()) == ([], 0, 0, 10, False)
    with pytest.raises(ValueError):
        paging.response(posts, [F.desc("id")], authors, "user_id", "aid", item, author, 0, 101)


FIELDS = [validation.Field("title", least=1, most=5), validation.Field("likes", "int", required=False, least=0, most=9), validation.Field("author.name"), validation.Field("place.zip", "int", required=False)]
BODIES = [
    '{"title": "abc", "likes": 3, "author": {"name": "x"}}', '{"title": "", "likes": "4", "author": {"name": "x"}, "place": {"zip": "12"}}', '{"title": "abcdef", "likes": -1, "author": {}}',
    '{"likes": "four", "author": "x", "place": {}}', '{"title": null, "likes": 10, "author": {"name": null}, "place": null}', '{"title": "abc"', "[1]", "5", "", None, "{}", ' {"title": "é", "author": {"name": 5}}', '{"title": "a", "author": {"name": "n"}, "likes": 99999999999999999999}',
]


def plain(body):
    if body is None:
        return [("body", "Field required")]
    try:
        top = json.loads(body)
    except ValueError:
        return [("body", "JSON decode error")]
    if not isinstance(top, dict):
        return [("body", "JSON decode error")]
    out = []
    for f in FIELDS:
        outer, dot, inner = f.path.partition(".")
        have = top.get(outer)
        v = (have.get(inner) if isinstance(have, dict) else None) if dot else have
        if v is None:
            if f.required or dot and have is not None:
                out.append((f"body.{f.path}", "Field required"))
        elif f.kind == "int":
            text = str(v)
            if not text.lstrip("+-").isdigit() or len(text.lstrip("+-")) > 18:
                out.append((f"body.{f.path}", "Input should be a valid integer"))
            elif f.least is not None and int(text) < f.least:
                out.append((f"body.{f.path}", f"Input should be greater than or equal to {f.least}"))
            elif f.most is not None and int(text) > f.most:
                out.append((f"body.{f.path}", f"Input should be less than or equal to {f.most}"))
        elif f.least is not None and len(str(v)) < f.least:
            out.append((f"body.{f.path}", f"String should have at least {f.least} characters"))
        elif f.most is not None and len(str(v)) > f.most:
            out.append((f"body.{f.path}", f"String should have at most {f.most} characters"))
    return out


def test_checked_bodies(spark):
    df = spark.createDataFrame([(i, b, "own") for i, b in enumerate(BODIES)], "id int, body string, place string").repartition(3)
    rows = validation.checked(df, "body", FIELDS)
    got = {r["id"]: r for r in rows.collect()}
    assert {i: [tuple(e) for e in got[i]["errors"]] for i in got} == {i: plain(b) for i, b in enumerate(BODIES)}
    assert tuple(got[0]["parsed"]) == ("abc", 3, "x", None) and tuple(got[1]["parsed"])[1:] == (4, "x", 12) and tuple(got[5]["parsed"]) == (None,) * 4
    good = {i for i, b in enumerate(BODIES) if not plain(b)}
    assert {r["id"] for r in validation.accepted(rows).collect()} == good and validation.accepted(rows).columns == ["id", "body", "place", "parsed"]
    assert validation.refused(rows).count() == sum(len(plain(b)) for b in BODIES)
    assert validation.checked(df.limit(0), "body", FIELDS).count() == 0


def test_helper_columns_never_clash(spark):
    df = spark.createDataFrame([(1, 7, "x")], "id int, fk int, _pk string")
    assert validation.without_parent(df, "fk", spark.createDataFrame([(8,)], "pk int"), "pk").columns == df.columns
