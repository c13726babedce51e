"""A batch of log lines is dealt to all tasks, and masked once for the state and for its hits."""

from obsflow.operators import mining
from obsflow.streaming import mining as stream_mining

LOG = "log_id string, ts_ns long, service string, severity_number int, trace_id string, span_id string, body string"


def test_batch_of_one_file_is_dealt_and_masked_once(spark, tmp_path, monkeypatch):
    seen = []

    def watched(step):
        def run(lines, *more):
            seen.append((lines, lines.storageLevel.useMemory, "RepartitionByExpression" in lines._jdf.queryExecution().analyzed().toString(), mining.TOKENS in lines.columns))
            return step(lines, *more)

        return run

    monkeypatch.setattr(stream_mining, "mine", watched(mining.mine))
    monkeypatch.setattr(stream_mining, "template_hits", watched(mining.template_hits))
    rows = [(f"{k:03}", k, f"s{k % 2}", 9, "", "", f"user {k} {'failed' if k % 3 else 'left'} twice") for k in range(60)]
    batch = spark.createDataFrame(rows, LOG).coalesce(1)
    stream_mining.mine_batch(batch, 0, str(tmp_path))
    assert [x[1:] for x in seen] == [(True, True, True)] * 2 and seen[0][0] is seen[1][0]
    assert not seen[0][0].storageLevel.useMemory
    hits = spark.read.parquet(f"{tmp_path}/hits").drop("batch_id")
    want = mining.template_hits(batch, mining.drain_templates(batch))
    assert hits.columns == want.columns and sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect())) and hits.count() == 60
