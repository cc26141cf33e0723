import time

from shardloom.llm import base


def test_shuffles_of_earlier_steps_go(spark, monkeypatch):
    """What a step shuffled is removed when the next begins, whether or not the driver runs short of memory."""
    monkeypatch.setattr(base, "RELEASE_S", 0, raising=False)
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()

    def held():
        base.cut(spark.range(1000).repartition(4, "id"))
        return known.size()

    held()
    time.sleep(1)
    first = known.size()
    for _ in range(6):
        held()
    ends = time.monotonic() + 20
    while known.size() > first + 2 and time.monotonic() < ends:
        time.sleep(0.1)
    assert known.size() <= first + 2
