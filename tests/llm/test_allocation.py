import math
import random

from corpusloom.llm.allocation import Cell, Flow, allocation_report, draw_sample, latest, solve


def test_cheapest_flow_against_enumeration():
    flow = Flow()
    a, b = flow.arc("s", "x", 3, 1.0), flow.arc("s", "y", 5, 2.0)
    flow.arc("x", "t", 2, 0.0), flow.arc("y", "t", 9, 0.0)
    flow.arc("x", "y", 9, 0.5)
    assert flow.run("s", "t", 100) == 8 and flow.used(a) == 3 and flow.used(b) == 5


def test_quotas_and_shortfalls():
    rng = random.Random(1)
    for seed in range(25):
        cells = [Cell(f"r{i}", f"c{j}", 0.0, rng.randint(0, 4), rng.choice([0, 2, 30, 500])) for i in range(3) for j in range(3)]
        weights = [rng.random() for _ in cells]
        for c, w in zip(cells, weights):
            c.share = w / sum(weights)
        size = rng.choice([10, 57, 200])
        solve(cells, size, seed)
        assert sum(c.quota for c in cells) == min(size, sum(c.available for c in cells))
        for c in cells:
            need = max(c.floor, c.share * size)
            assert c.shortfall == max(0, math.ceil(need - 1e-9) - c.available) and 0 <= c.quota <= c.available
        if sum(min(c.floor, c.available) for c in cells) <= size:
            assert all(c.quota >= min(c.floor, c.available) for c in cells)


def test_fractional_targets_are_drawn_at_random():
    drawn = set()
    for seed in range(40):
        cells = [Cell("r", f"c{j}", 0.25, 0, 100) for j in range(4)]
        solve(cells, 10, seed)
        assert sorted(c.quota for c in cells) == [2, 2, 3, 3]
        drawn.add(tuple(c.quota for c in cells))
    assert len(drawn) > 3


def test_what_a_cell_lacks_goes_to_its_row_and_column():
    cells = [Cell(f"r{i}", f"c{j}", 0.25 if i < 2 and j < 2 else 0.0, 0, 1_000) for i in range(3) for j in range(3)]
    cells[0].available = 5
    solve(cells, 100, 1)
    assert cells[0].shortfall == 20 and cells[0].quota == 5 and sum(c.quota for c in cells) == 100
    # What the first cell cannot give is taken where it mends one of its margins.
    assert sum(c.quota for c in cells if c.row == "r0" or c.column == "c0") == 75


def test_report_and_sample_agree_with_the_counts(spark):
    rng = random.Random(5)
    rows = [(f"q{i}", rng.choice("abc"), rng.choice("xy"), i) for i in range(700)]
    pool = latest(spark.createDataFrame(rows, "n string, question_type string, difficulty string, at bigint"), "n", "at", ["question_type", "difficulty"])
    goals = [("a", "x", 0.5, 0, 333), ("b", "y", 0.3, 0, 333), ("c", "x", 0.1, 60, 333), ("c", "y", 0.1, 0, 333)]
    targets = spark.createDataFrame(goals, "question_type string, difficulty string, target_share double, min_rows bigint, sample_size bigint")
    report = {(r.question_type, r.difficulty): r for r in allocation_report(pool, targets).collect()}
    have = {k: sum((t, d) == k for _, t, d, _ in rows) for k in report}
    for t, d, share, floor, size in goals:
        r = report[t, d]
        assert r.available == have[t, d] and r.shortfall == max(0, math.ceil(max(floor, share * size) - 1e-9) - have[t, d])
        assert r.quota >= min(have[t, d], floor)
    assert sum(r.quota for r in report.values()) == 333
    drawn = draw_sample(pool, targets, "n")
    assert {(r[0], r[1]): r[2] for r in drawn.groupBy("question_type", "difficulty").count().collect()} == {k: r.quota for k, r in report.items()}
    kinds = {n: (t, d) for n, t, d, _ in rows}
    assert all(kinds[r.n] == (r.question_type, r.difficulty) for r in drawn.collect())


def test_sample(spark):
    rows = [(f"q{i}", "Factual" if i % 3 else "multi-hop", "EASY " if i % 2 else " hard", i, "x") for i in range(900)]
    rows += [("q1", None, "easy", 5000, "x"), ("q2", "FACTUAL", "hard", -5, "x"), (None, "factual", "easy", 1, "x"), ("z", None, "", 1, "x"), ("q3", "multi hop", "easy", 3, "x")]
    pool = latest(spark.createDataFrame(rows, "n string, question_type string, difficulty string, at bigint, cell string"), "n", "at", ["question_type", "difficulty"])
    goals = spark.createDataFrame([("factual", "easy", 0.5, 2, 100), ("factual", "hard", 0.3, 2, 100), ("multi_hop", "easy", 0.2, 2, 100), ("other", "easy", 0.0, 5, 100)], "question_type string, difficulty string, target_share double, min_rows bigint, sample_size bigint")
    report = {(r.question_type, r.difficulty): r for r in allocation_report(pool, goals).collect()}
    assert report[("other", "easy")].shortfall == 5 and report[("factual", "easy")].shortfall == 0
    sample = draw_sample(pool, goals, "n", buckets=4)
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("question_type", "difficulty").count().collect()}
    assert counts == {k: r.quota for k, r in report.items() if r.quota} and sum(counts.values()) == 100
    assert sample.select("n").distinct().count() == 100
    assert allocation_report(pool, goals.limit(0)).count() == 0 == draw_sample(pool, goals.limit(0), "n").count()
    assert [r.available for r in allocation_report(pool.limit(0), goals).collect()] == [0] * 4 and draw_sample(pool.limit(0), goals, "n").count() == 0
