import datetime

from brightloom.llm import time_tree

DAY = datetime.datetime(2024, 1, 1)


def sent_by_tasks(spark, after):
    """{stage: bytes that one of its tasks sends to the driver}, of stages after that one."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    done = [stages.apply(i) for i in range(stages.size())]
    return {s.stageId(): s.resultSize() / s.numCompleteTasks() for s in done if s.stageId() > after and s.numCompleteTasks()}


def test_tasks_of_point_in_time_send_little_more_than_any_task(spark, tmp_path):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    sales = [(i, i % 2, at(i), at(i + 1), 1.5) for i in range(200)]
    clicks = [(i, i % 2, at(i), at(i + 1), "purchase" if i % 3 else "view", 2.5) for i in range(200)]
    lines = [(i, i % 5, at(i + 2), 3.5) for i in range(200)]
    tables = {"clicks": (clicks, "click_id long, client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"), "sales": (sales, "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, total double"), "lines": (lines, "sale_id long, item_id long, shipped_at timestamp_ntz, amount double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    before = max(sent_by_tasks(spark, -1), default=-1)
    out = time_tree.point_in_time(*(spark.read.parquet(f"{tmp_path}/{n}") for n in tables), bucket=16)
    assert out.count() == 400
    sent = sent_by_tasks(spark, before)
    # a plan that runs through the whole job had 29 kB for each task of its last stage; plans that are cut have half of that
    assert len(sent) > 20 and max(sent.values()) < 18_000, sent
