"""Connected components against union-find, and how much work a round is."""

import random

from obsflow.llm.common import stored
from obsflow.llm.components import components


def roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_paths_hubs_and_strangers(spark):
    draw = random.Random(1)
    path = draw.sample(range(-(10**6), 10**6), 90)
    links = list(zip(path, path[1:], strict=False)) + [(5 * 10**6 + 70, 5 * 10**6 + k) for k in range(140)] * 2
    links += [(draw.randrange(2 * 10**6, 2 * 10**6 + 300), draw.randrange(2 * 10**6, 2 * 10**6 + 300)) for _ in range(130)] + [(None, 3), (4, 4), (None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # a node's links run over batches
    try:
        found = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found)) and dict(found) == roots(links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_is_few_tasks(spark):
    path = random.Random(2).sample(range(1000), 60)
    links = stored(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long"), "test")
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc.setJobGroup("components", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        components(links)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setJobGroup("else", "")
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert tasks < 400, tasks  # with a repeat test and shuffles for the end it took 686
