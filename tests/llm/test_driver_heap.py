"""Queries of many steps give the driver's grown heap back between them, and what was freed outside it."""

import sys
from types import SimpleNamespace as Fake

import pytest
from py4j.protocol import Py4JError

from quillpack.llm import store


@pytest.mark.parametrize("committed, collected", [(600, True), (400, False)])
def test_a_grown_heap_is_collected(monkeypatch, committed, collected):
    seen = []
    monkeypatch.setattr(store, "release", seen.append)
    runtime = Fake(totalMemory=lambda: committed, maxMemory=lambda: 1000)
    fake = Fake(sparkContext=Fake(_jvm=Fake(java=Fake(lang=Fake(Runtime=Fake(getRuntime=lambda: runtime))))))
    assert store.tidy(fake) is collected and seen == [fake] * collected


def test_every_step_looks_at_the_heap(spark, monkeypatch):
    seen, tidy = [], store.tidy
    monkeypatch.setattr(store, "tidy", lambda s: seen.append(tidy(s)))
    assert store.settle(spark.range(3)).count() == 3
    with store.Scratch(spark) as scratch:
        assert scratch.save(spark.range(4), "four").count() == 4
    assert len(seen) == 2


def test_every_step_gives_back_what_was_freed_outside_the_heap(spark, monkeypatch):
    version = spark.sparkContext._jvm.java.lang.Runtime.version()
    if sys.platform != "linux" or (version.feature(), version.interim(), version.update()) < (17, 0, 9):
        pytest.skip("this JVM has no command for it")
    seen, trim = [], store.trim
    monkeypatch.setattr(store, "trim", lambda s: seen.append(trim(s)))
    assert store.settle(spark.range(3)).count() == 3
    with store.Scratch(spark) as scratch:
        assert scratch.save(spark.range(4), "four").count() == 4
    assert seen == [True, True]


def test_a_jvm_without_the_command_goes_on():
    def refused(name):
        raise Py4JError(name)

    assert store.trim(Fake(sparkContext=Fake(_gateway=None, _jvm=Fake(java=Fake(lang=Fake(Class=Fake(forName=refused))))))) is False
