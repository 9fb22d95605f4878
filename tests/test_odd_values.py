"""Values that the smallest tables don't hold, against DuckDB: zeros, nulls, ties."""

import duckdb

from cadenza.plans import library, scores


def stored(spark, tmp_path, values, name="events"):
    """A table of events with these values, a minute apart, as the driver's tables are; its folder and a connection that sees it."""
    rows = [(i, i % 3, "click", None if v is None else float(v), "{}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return str(tmp_path), con


def same(query, sql, spark, folder, con):
    df = query(spark, folder)
    found = con.execute(sql)
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_chance_rate_of_no_tempo(spark, tmp_path):
    folder, con = stored(spark, tmp_path, [0, 1, 120, 5000, None])
    same(scores.agg47, scores.ORACLES["agg47_chance_rates"], spark, folder, con)


def test_no_step_of_nothing(spark, tmp_path):
    folder, con = stored(spark, tmp_path, [0, -3, 1, 50, 50.5, None])
    same(library.dat06, library.ORACLES["dat06_progression"], spark, folder, con)


def test_projection_works_out_each_vector_once(spark):
    """The matrix and the unit vector stand once in the expression, not once for each component that is divided by a length."""
    import math
    import time

    from pyspark.sql import functions as F

    from cadenza.functions import exprs

    matrix = [[((i * 7 + j * 3) % 11 - 5) / 5.0 for j in range(8)] for i in range(64)]
    df = spark.range(4000, numPartitions=4).withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * 64 + i)))
    start = time.time()
    got = {r.id: r.p for r in df.select("id", exprs.projected(F.col("v"), matrix).alias("p")).collect()}
    assert time.time() - start < 20
    v = [math.sin(7 * 64 + i) for i in range(1, 65)]
    o = [sum(x * r[j] for x, r in zip(v, matrix, strict=True)) for j in range(8)]
    assert all(abs(a - b / math.hypot(*o)) < 1e-12 for a, b in zip(got[7], o, strict=True))
    odd = spark.createDataFrame([([0.0] * 64,), ([1.0] * 63,), (None,), ([float("nan")] * 64,)], "v array<double>")
    assert [r.p for r in odd.select(exprs.projected(F.col("v"), matrix).alias("p")).collect()] == [None] * 4


def test_nearest_fraction_by_fractions(spark):
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F

    from cadenza.functions.fractions import nearest_fraction

    rng = random.Random(4)
    rows = [(rng.choice([1, -1]) * rng.randrange(10 ** rng.randrange(1, 19)), rng.randrange(1, 10 ** rng.randrange(1, 19)), rng.choice([1, 2, 1000, 10**6, 10**18])) for _ in range(3000)]
    rows += [(10**18 - 1, 1, 10**18), (1, 10**18 - 1, 10**18), (0, 5, 3), (5, 10, 1), (15, 10, 1), (-5, 10, 1)]
    df = spark.createDataFrame([*rows, (None, 1, 5), (1, None, 5), (1, 0, 5), (1, -2, 5)], "n long, d long, most long")
    got = [r.r for r in df.select(nearest_fraction(F.col("n"), F.col("d"), F.col("most")).alias("r")).collect()]
    assert got[-4:] == [None] * 4
    for (n, d, most), r in zip(rows, got, strict=False):
        want = Fraction(abs(n), d).limit_denominator(most)
        assert (r.num, r.den) == (want.numerator * (-1 if n < 0 else 1), want.denominator), (n, d, most)
    assert "LambdaFunction" not in df.select(nearest_fraction(F.col("n"), F.col("d"), 1000))._jdf.queryExecution().analyzed().toString()


def test_equal_contrasts_of_sections(spark, tmp_path):
    """Changes of the same size by different samples: the means have to be added up as the SQL's are, or another one is the strongest."""
    from cadenza.plans import series

    curves = {
        0: [1637, 12051, 5147, 953, 787, 6142, 17097, 231, 6706, 7893, 670, 4775, 1411, 1310, 4305, 97, 17173, 754, 13035, 2064, 7967, 8105, 4370, 13380, 19310, 9948, 1477, 388, 10161,
            6688, 323, 380, 1145, 6225, 848, 531, 1472, 138, 1409, 8323, 13126, 480, 2136, 6070, 5043, 9737, 8232, 14379, 7078, 3414, 235, 926, 1731],
        1: [10368, 452, 2047, 6129, 4470, 2282, 1817, 13347, 7177, 13905, 185, 5366, 1668, 6838, 4834, 641, 790, 99, 1779, 1703, 1210, 17095, 2066, 2349, 5795, 1519, 1495, 752, 2101,
            10256, 65, 2825, 12403, 13065, 179, 7810, 4719, 4651, 6034, 7254, 10032, 5803, 12519, 1466, 14168, 2738, 5765, 6739, 3756, 6320, 2085, 10481, 8068, 6931, 4627, 50, 2629, 5008,
            1187, 11507, 16, 6205, 5762, 5653, 6563, 1735, 1126, 1304],
    }
    rows = [(1000 * k + i, k, v / 100) for k, x in curves.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df = df.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id) as ts", "user_id", "'click' as event_type", "value", "'{}' as props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(series.win08_sections, series.ORACLES["win08_sections"], spark, str(tmp_path), con)


def test_halves_are_rounded_as_the_sql_does(spark):
    import math

    from cadenza.plans import series

    halves = [k / 2e9 for k in (0, 1, -1, 426953125, 103034921875, -103034921875, 99753203125)]
    xs = [x for h in halves for x in (h, math.nextafter(h, -1e9), math.nextafter(h, 1e9))] + [4.2e7, -3.1e12, 1e-8]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", series._rounded("x").alias("x")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchall()[0][0] for x in xs]
