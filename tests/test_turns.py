"""The conversation log: numbers, merging, the order of turns and the last response from one file."""

import random

from lanternbase.sources.turns import ROWS, TurnLog


def test_log_over_many_appends(spark, tmp_path):
    rng, log, want = random.Random(1), TurnLog(spark, str(tmp_path), fanout=3), []
    assert log.turns().count() == 0 and log.last_response().count() == 0 and log.ordered().count() == 0
    for i in range(7):
        rows = [(f"s{i}", k, rng.choice(["user", "assistant"]), f"t{i}-{k}", rng.choice([None, f"r{i}-{k}"]), float(rng.randrange(1000))) for k in range(rng.randrange(1, 5))]
        log.append(spark.createDataFrame(rows, ROWS).coalesce(1))
        want += rows
    got = log.turns().collect()
    assert sorted((r.session_id, r.turn_index, r.role, r.content, r.response_id, r.ts) for r in got) == sorted(want, key=lambda r: r[:2])
    assert len({r.id for r in got}) == len(want) and len(log._files()) < 7
    order = [(r.ts, r.turn_index, r.id) for r in sorted(log.ordered().collect(), key=lambda r: r.place)]
    assert order == sorted(order) and sorted(r.place for r in log.ordered().collect()) == list(range(1, len(want) + 1))
    last = max((r.ts, r.turn_index, r.id) for r in got if r.role == "assistant" and r.response_id)
    assert [r.id for r in log.last_response().collect()] == [last[2]]


def test_one_file_is_read_for_the_last_response(spark, tmp_path):
    log = TurnLog(spark, str(tmp_path))
    rows = spark.range(10_000).selectExpr("cast(id div 10 as string) as session_id", "id % 10 as turn_index", "if(id % 2 = 1, 'assistant', 'user') as role", "concat('c', id) as content", "if(id % 2 = 1 and id < 9000, concat('r', id), null) as response_id", "cast(id as double) as ts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or so few bytes would be one file
    try:
        log.append(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(log._files()) > 1 and log.turns().count() == 10_000
    found = log.last_response()
    assert found.first().response_id == "r8999" and len(found.inputFiles()) == 1
    assert [r.ts for r in sorted(log.ordered().collect(), key=lambda r: r.place)] == [float(i) for i in range(10_000)]
