"""The messages of every session are returned, in order."""

from hireframe.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_messages_of_all_sessions(spark):
    rows = [(r["thread"], r["seq"]) for r in catalogue.queries()["o7_messages"](spark, DIR).collect()]
    wanted = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn").collect()
    assert rows == sorted((r["conv_id"], r["turn"]) for r in wanted) and len({t % 7 for t, _ in rows}) == 7
