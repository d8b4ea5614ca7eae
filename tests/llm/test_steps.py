"""Plans of several Newton steps grow with the number of steps."""

from progdf.llm import mixing


def test_each_step_reads_the_state_once(spark):
    state = spark.createDataFrame([("=a", 30.0, 0.0, -1.0, 0.7, False), ("=b", 9.0, 0.25, 0.0, 0.7, True)], "key string, target double, x double, lo double, hi double, done boolean")
    counts = spark.createDataFrame([("=a", 10, 2), ("=a", 5, 4), ("=b", 3, 3)], "key string, size long, n long")
    leaves, now = [], state
    for _ in range(4):
        now = mixing.newton_step(now, counts, 2)
        leaves.append(now._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert leaves == [2, 3, 4, 5]
    got = {r["key"]: r for r in now.collect()}
    assert tuple(got["=b"]) == ("=b", 9.0, 0.25, 0.0, 0.7, True)
    for _ in range(3):
        now = mixing.newton_step(now, counts, 2)
    x = {r["key"]: r["x"] for r in now.collect()}["=a"]
    assert abs(20 * 2.718281828459045 ** (10 * x) + 20 * 2.718281828459045 ** (5 * x) - 30) < 1e-6
