"""Drain over distinct sequences against line-by-line Drain, text expressions, sources."""

import random
import re

import pytest
from pyspark.sql import functions as F

from obsflow.functions import text
from obsflow.operators import mining
from obsflow.sources import metrics, otlp
from obsflow.streaming import assembly
from obsflow.streaming import mining as stream_mining

LOG = "log_id string, ts_ns long, service string, severity_number int, trace_id string, span_id string, body string"


def naive_drain(lines, most, most_children=100):
    """Line by line, as the method is described: (service, tokens) of each line -> the first text of the cluster it goes to."""
    services, out = {}, []
    for service, tokens in lines:
        tree = services.setdefault(service, {"nodes": {}, "n": 0})
        where = (len(tokens),)
        for token in tokens[:2]:
            names = tree["nodes"].setdefault(where, {})
            if token not in names and len(names) >= most_children and not re.fullmatch("[1-5][0-9][0-9]", token):
                token = "<*>"
            names[token] = True
            where += (token,)
        leaf = tree["nodes"].setdefault(("leaf", *where), [])
        best = None
        for cluster in leaf:
            pairs = list(zip(cluster["now"], tokens, strict=True))
            if any(a != b and (re.fullmatch("[1-5][0-9][0-9]", a) or re.fullmatch("[1-5][0-9][0-9]", b)) for a, b in pairs):
                continue
            share = sum(a == b or a == "<*>" for a, b in pairs) / len(tokens)
            if share >= 0.5 and (best is None or share > best[0]):
                best = share, cluster
        if best:
            best[1]["now"] = [a if a == b else "<*>" for a, b in zip(best[1]["now"], tokens, strict=True)]
            out.append(best[1]["first"])
        elif tree["n"] >= most:
            out.append("<overflow>")
        else:
            tree["n"] += 1
            leaf.append({"now": tokens, "first": " ".join(tokens)})
            out.append(" ".join(tokens))
    return out


def lines_of(draw, n):
    """Lines that repeat, generalise one another's templates and come again later."""
    pool = [" ".join([draw.choice(["get", "put", "del"]), draw.choice("abcd") + "x", *(draw.choice(["ok", "failed", "late", "404", "200", "id 77"]) for _ in range(draw.randint(1, 3)))]) for _ in range(n // 3)]
    return [(f"{k:05}", k // 2, "s" + str(k % 2), 9, "", "", draw.choice(pool)) for k in range(n)]


def masked(body):
    return ["<*>" if w.isdigit() and not re.fullmatch("[1-5][0-9][0-9]", w) else w for w in body.split()]


def expected_ids(spark, rows, config):
    firsts = naive_drain([(r[2], masked(r[6])) for r in rows], config.max_clusters, config.max_children)
    named = spark.createDataFrame([(r[0], r[2], f) for r, f in zip(rows, firsts, strict=True)], "log_id string, service string, first string")
    return {r.log_id: r.t for r in named.select("log_id", text.short_hash(F.col("service"), F.col("first")).alias("t")).collect()}


@pytest.mark.parametrize(("most", "most_children"), [(5000, 100), (5000, 2), (12, 100), (5, 2)])
def test_hits_equal_line_by_line_drain(spark, most, most_children):
    """With room for all clusters, and with sequences that find none and are tried again when their leaf changes."""
    rows = keep_status(lines_of(random.Random(most), 700))
    config = mining.Config(max_children=most_children, max_clusters=most)
    logs = spark.createDataFrame(rows, LOG)
    hits = {r.log_id: r.template_id for r in mining.template_hits(logs, mining.drain_templates(logs, config), config).collect()}
    want = expected_ids(spark, rows, config)
    assert hits == want
    if most == 12:
        assert len(set(want.values())) == 2 * (most + 1)


def keep_status(rows):
    """Bodies in which the product's own token rules mask nothing but what masked() does."""
    return [(*r[:6], r[6].replace("404", "nope").replace("200", "fine")) for r in rows]


@pytest.mark.parametrize("most", [5000, 9])
def test_hits_after_a_restore_equal_one_run(spark, tmp_path, most):
    rows = keep_status(lines_of(random.Random(8), 600))
    config = mining.Config(max_children=3, max_clusters=most)
    want = expected_ids(spark, rows, config)
    found = {}
    for k, part in enumerate((rows[:150], rows[150:400], rows[400:])):
        batch = spark.createDataFrame(part, LOG)
        for _ in range(2):  # a batch that comes again changes nothing
            stream_mining.mine_batch(batch, k, str(tmp_path), config)
        found |= {r.log_id: r.template_id for r in spark.read.parquet(f"{tmp_path}/hits/batch_id={k}").collect()}
    assert found == want


def test_token_rules(spark):
    lines = ["", "a  b", 'GET /x1 HTTP/1.1" 500 ok', "took 500 ms", " ".join(["w"] * 70)]
    frame = spark.createDataFrame([(x,) for x in lines], "body string")
    got = [r.t for r in frame.select(text.log_tokens(F.col("body")).alias("t")).collect()]
    assert got[0] == ["<empty>"] and got[1] == ["a", "b"]
    assert got[2] == ["GET", "<*>", "<*>", "500", "ok"] and got[3] == ["took", "<*>", "ms"]
    assert len(got[4]) == 65 and got[4][-1] == "<…>"


def test_paths_hosts_and_cuts(spark):
    frame = spark.createDataFrame([("https://u:p@h.example:80/a/b1/c?d=/e#f",), ("",), ("http://[::1]:9/x",), ("/plain/" + "z" * 25,)], "u string")
    rows = frame.select(text.normalize_path(F.col("u")).alias("p"), text.url_host(F.col("u")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("/a/<*>/c", "h.example"), ("/", None), ("/x", "[::1]"), ("/plain/<*>", None)]
    cut = spark.createDataFrame([("aéé",)], "t string").select(text.truncate_utf8(F.col("t"), 4).alias("t")).first().t
    assert cut == "aé"


def test_openmetrics_edges(spark):
    lines = ['# HELP x', 'up 1', 'h_bucket{le="+Inf",a="q\\"\\\\n\\n"} 5 # {id="1"} 2', "bad{", "n NaN", "i -Inf 12"]
    good, bad = metrics.parse_openmetrics(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {r.name: r for r in good.collect()}
    assert set(rows) == {"up", "h_bucket", "n", "i"} and bad.first().malformed == 1
    assert rows["h_bucket"].labels == {"le": "+Inf", "a": 'q"\\n\n'} and rows["i"].value == float("-inf")


def test_otlp_values(spark):
    request = '{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"spans":[{"traceId":"AB","spanId":"1","name":"n","kind":9,"startTimeUnixNano":"10","endTimeUnixNano":"4","attributes":[{"key":"k","value":{"doubleValue":1.0}},{"key":"k","value":{"stringValue":"second"}},{"key":"b","value":{"bytesValue":"/w=="}},{"key":"l","value":{"arrayValue":{"values":[{"intValue":"1"},{"boolValue":true}]}}}]}]}]}]}'
    frame = spark.createDataFrame([(request,), ("{broken",)], "value string")
    (row,) = otlp.spans_of(frame).collect()
    assert (row.trace_id, row.service, row.kind, row.status, row.duration_ns, row.end_ns) == ("ab", "unknown_service", "unspecified", "unset", 0, 10)
    assert row.attrs == {"k": "1", "b": "ff", "l": '["1","true"]'}
    assert otlp.split_undecodable(frame, otlp.TRACES)[1].count() == 1


def test_sessions_by_arrival(spark):
    rows = [("t", 0, "a"), ("t", 5, "b"), ("t", 30, "c"), ("u", 0, "a"), ("u", 1, "b"), ("u", 2, "c"), ("u", 3, "d")]
    frame = spark.createDataFrame(rows, "trace_id string, arrival_ms long, seq string")
    out = {(r.trace_id, r.seq): (r.late, r.truncated) for r in assembly.sessionize_batch(frame, 10, 100, 2).collect()}
    assert out[("t", "c")] == (True, False) and out[("t", "b")] == (False, False)
    assert out[("u", "c")] == (False, True) and out[("u", "d")] == (True, True)
