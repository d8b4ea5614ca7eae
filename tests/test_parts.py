"""Tasks take rows of a bounded size, however large the input is."""

from progdf.functions import parts
from progdf.plans import registry


def test_shuffles_are_cut_by_the_size_of_the_input(spark, monkeypatch):
    first, advised = parts._FIRST, parts._ADVISED
    before = spark.conf.get(advised)
    try:
        registry.QUERIES["cg_resolved"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(first, None) is None and spark.conf.get(advised) == str(8 << 20) + "b"
        monkeypatch.setattr(parts, "INPUT", 1 << 10)
        registry.QUERIES["cg_resolved"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(first)) == -(-parts.stored(spark, "/root/testdata/sf0.001") // 1024) > 4
        spark.conf.set(advised, "1m")
        registry.QUERIES["cg_resolved"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(advised) == "1m"
    finally:
        spark.conf.unset(first)
        spark.conf.set(advised, before)
