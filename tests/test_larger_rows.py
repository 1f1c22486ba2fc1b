"""Queries against their SQL over rows that the small tables don't have."""

import math

import duckdb
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from rivulet.functions import parse
from rivulet.operators import dag, network, noding, simplify
from rivulet.operators.lineage import cut
from rivulet.plans import registry
from test_oracles import _key, _same


def _matches(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall(), key=_key)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    assert len(got) == len(want) > 0
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def _embeddings(folder, ids, seed=3):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"vec_id": ids, "label": rng.integers(0, 3, len(ids)).astype("int32"), "embedding": list((0.13 * rng.normal(size=(len(ids), 4))).astype("float32"))})
    duckdb.connect().execute(f"COPY (SELECT vec_id::BIGINT AS vec_id, label, embedding::FLOAT[] AS embedding FROM rows) TO '{folder}/embeddings.parquet'")


def test_segment_edges_where_pieces_share_ids(spark, tmp_path):
    """From vector 40,000 on the number of a piece runs into those of the next label."""
    _embeddings(tmp_path, [*range(240), *range(40_000, 40_240)])
    _matches(spark, tmp_path, "segment_edges")


def test_source_lines_whose_middle_lies_far_from_a_line_they_meet(spark):
    """Of lines that meet a piece the middle of its first segment decides, also when it is farther from the line than the search reaches."""
    piece = spark.createDataFrame([(5, 1, k, k / 10, 0.0) for k in range(11)], "edge long, piece long, k int, x double, y double")
    near = [(0.95, -0.1), (0.95, 0.1), (0.95, 0.3), (0.35, 0.3)]
    lines = spark.createDataFrame([(0, 0, 0.75, -0.1), (0, 1, 0.75, 0.1)] + [(1, k, x, y) for k, (x, y) in enumerate(near)], "edge long, k int, x double, y double")
    found = noding.source_lines(piece, lines, 0.05).collect()
    assert [(r.line, r.distance) for r in found] == [(1, 0.0)]


def test_nearest_edge_among_many_crossing_lines(spark, tmp_path):
    _embeddings(tmp_path, list(range(1_500)), seed=5)
    _matches(spark, tmp_path, "nearest_edge")


def test_river_names_whose_lengths_are_equal_in_another_order(spark):
    """0.3 + 0.2 + 0.1 and 0.1 + 0.2 + 0.3 differ as doubles; both tributaries are 0.6 long, so the smaller id comes first."""
    rows = [(0, None, 1.0), (1, 0, 9.0), (10, 0, 0.3), (11, 10, 0.2), (12, 11, 0.1), (20, 0, 0.1), (21, 20, 0.2), (22, 21, 0.3)]
    named = dag.name_rivers(spark.createDataFrame(rows, "id long, parent long, length double"), "length", "Main", ["Elm", "Oak"])
    assert {r.id: r.name for r in named.where("id = stem").collect()}.items() >= {10: "Elm", 20: "Oak"}.items()
    sums = network.upstream_sums(spark.createDataFrame([(1, None, 1e200), (2, 1, 5e-3)], "id long, parent long, v double"), ["v"])
    assert {r.id: r.v for r in sums.collect()} == {1: 1e200, 2: 5e-3}


def test_parse_time_works_out_its_text_once(spark):
    rows = [("2015-1-2 3:04:60", "2015-01-02 03:05:00"), ("'2015/1/2'", "2015-01-02 00:00:00"), ("2015年3月日", "2015-03-01 00:00:00"), ("2015-2-30", None), ("12345", "1933-10-18 00:00:00"), ("2015-1-2 3:4", "2015-01-02 03:04:00")]
    read = spark.createDataFrame(rows, "text string, want string").select("want", parse.parse_time(F.concat("text", F.lit(" "))).cast("string").alias("got"))
    assert all(r.got == r.want for r in read.collect())
    assert read._jdf.queryExecution().analyzed().toString().count("concat(") == 1


def test_upstream_edges_on_ladders_and_cycles(spark):
    """Random networks, some with cycles, against walks by hand; and a ladder of two ways at each of 40 nodes, whose ways are too many to tell apart."""
    rng = np.random.default_rng(4)
    for n, ends in ((40, 90), (60, 60), (30, 25)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (ends, 2)) if n != 60 or a > b]
        pairs += [(200 + 3 * k + i, 203 + 3 * k + j) for k in range(13) for i in (0, 1) for j in (0, 1)]
        edges = [(e, a, b, float(e)) for e, (a, b) in enumerate(pairs)]
        frame = spark.createDataFrame(edges, "edge long, from_node long, to_node long, length double")
        want = {}
        for node in {x for p in pairs for x in p}:
            seen, todo = set(), [node]
            above = set()
            while todo:
                at = todo.pop()
                for e, a, b, _ in edges:
                    if b == at:
                        above.add(e)
                        if a not in seen:
                            seen.add(a)
                            todo.append(a)
            want[node] = above
        assert {r.node: (r.edges, r.length) for r in dag.distinct_totals(frame).collect()} == {k: (len(v), float(sum(v))) for k, v in want.items()}
        if n == 30:
            assert {(r.node, r.edge) for r in dag.upstream_edges(frame).collect()} == {(k, e) for k, v in want.items() for e in v}


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Smallest neighbours are the nodes before, so one round of doubled pointers is enough; the random links need several and have loops, stars and pairs."""
    asked = []
    monkeypatch.setattr(network, "first_marked", lambda *a, real=network.first_marked: asked.append(1) or real(*a))
    chain = network.components(spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b"))
    assert {r.component for r in chain.collect()} == {0} and chain.count() == 300 and len(asked) == 1
    rng = np.random.default_rng(2)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 400, (260, 2))] + [(1000, 1000 - k) for k in range(1, 9)] + [(2000, 2000)]
    least = {x: x for p in pairs for x in p}
    for _ in range(len(least)):
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    assert {r.id: r.component for r in network.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == least
    assert network.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_size_guesses_of_loops_stay_numbers(spark):
    """Each round's guess is at least the square of the last one's: after 15 rounds of these without an end to it, 10 to the power of several hundred thousands."""
    rows = cut(spark.range(8).selectExpr("id", "id % 3 AS up"))
    for _ in range(15):
        rows = cut(rows.join(rows.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").selectExpr("id", "far AS up"))
    told = rows._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert int(told.partition("E+")[2].split(" ")[0] or 0) < 5_000
    assert {r.id: r.up for r in rows.collect()} == {k: k % 3 for k in range(8)} and rows.schema["id"].dataType.simpleString() == "bigint"


def test_simplified_lines_split_one_vertex_at_a_time(spark, monkeypatch):
    """The farthest vertex of a zigzag that dies out is always the first one left, so each split is one as deep as the last."""
    cuts = []
    monkeypatch.setattr(simplify, "cut", lambda df, real=simplify.cut: cuts.append(1) or real(df))
    zigzag = [(7, k, float(k), (-1.0) ** k * (2000 - k)) for k in range(2000)]
    found = simplify.simplify(spark.createDataFrame(zigzag, "edge int, k int, x double, y double"), 0.5)
    assert found.count() == 2000 and len(cuts) < 10


def test_simplified_lines_by_rounds_and_at_once(spark):
    """Long stretches by rounds and short ones at once keep the same vertices, also of equal distances, odd values, keys that repeat and named lines."""
    rng = np.random.default_rng(8)
    rows = [(f"w{e}", k, float(x), float(y)) for e in range(2) for k, (x, y) in enumerate(np.cumsum(rng.normal(size=(100, 2)), 0))]
    rows += [("steps", k, float((k + 1) // 2), float(k // 2 + k % 7 % 2)) for k in range(60)] + [("dot", 4, 1.0, 1.0), ("two", 0, 0.0, 0.0), ("two", 9, 1.0, 1.0), ("two", 3, None, 5.0)]
    rows += [("odd", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, float("nan")), (2.0, 3.0), (float("inf"), 1.0), (4.0, 4.0), (5.0, -9.0), (6.0, 0.0), (0.0, 0.0)])]
    rows += [("twice", k // 2, k / 3, float(k * k % 11)) for k in range(24)]
    lines = spark.createDataFrame(rows, "edge string, k long, x double, y double")
    kept = lambda at_once: sorted(map(repr, simplify.simplify(lines, 0.8, at_once).collect()))
    at_once = kept(1_000)
    assert len({r.split(" x=")[0] for r in at_once}) == len(at_once) and at_once == kept(25)


def test_source_lines_look_only_near_the_ends_and_middles(spark, monkeypatch):
    """Two long lines that all pieces meet: the pairs of their middles and ends with segments follow the pieces, not the lines' length, and find what all segments would."""
    rng = np.random.default_rng(6)
    wave = lambda n, shift: [(k / 10, math.sin(k / 7 + shift) / 3) for k in range(n)]
    lines = [wave(3_000, 0.0), wave(3_000, 2.0)[::-1]]
    pieces = [[(x + d * way, float(y)) for d, y in zip((0.0, 0.1, 0.2), rng.normal(size=3) / 3, strict=True)] for x, way in zip(rng.uniform(1, 299, 150), rng.choice([-1, 1], 150), strict=True)]
    pairs = []

    def watched(*a, real=noding.within_reach):
        rows, paired = real(*a)
        pairs.append((paired(rows).count(), rows.select("edge", "piece", "line", "spot").distinct().count()))
        return rows, paired

    monkeypatch.setattr(noding, "within_reach", watched)
    made = lambda shapes, names: spark.createDataFrame([(*key, k, float(x), float(y)) for key, p in shapes for k, (x, y) in enumerate(p)], names)
    given = made([((5, n), p) for n, p in enumerate(pieces)], "edge long, piece long, k int, x double, y double"), made([((n,), p) for n, p in enumerate(lines)], "edge long, k int, x double, y double")
    found = {r.piece: (r.line, r.forward) for r in noding.source_lines(*given, 2.0).collect()}
    assert all(n < 40 * spots for n, spots in pairs) and pairs[1][1] == 300

    def nearest(p, line):
        a, b = np.array(line[:-1]), np.array(line[1:])
        length = np.hypot(*(b - a).T)
        u = np.clip(((p - a) * (b - a)).sum(1) / length**2, 0, 1)
        away = np.hypot(*(p - a - u[:, None] * (b - a)).T)
        return away.min(), (np.cumsum(length) - length + u * length)[away.argmin()]

    for n, piece in enumerate(pieces):
        line, forward = found[n]
        assert forward == (nearest(np.array(piece[0]), lines[line])[1] < nearest(np.array(piece[-1]), lines[line])[1])
    tied = pairs[0][1] // 2
    assert tied > 30
    middles = [(np.array(p[0]) + np.array(p[1])) / 2 for p in pieces]
    assert sum(found[n][0] == min((0, 1), key=lambda e: nearest(m, lines[e])[0]) for n, m in enumerate(middles)) >= tied
