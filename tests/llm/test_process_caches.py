"""Caches of a worker process."""

from annolake.llm import common


def test_a_task_of_another_module_empties_the_caches():
    held = common.Cache(len)
    common.enter("first")
    assert held["word"] == 4
    common.enter("first")
    assert dict(held) == {"word": 4}
    common.enter("second")
    assert not held and held["word"] == 4
