"""What Python workers keep between the tasks of one session."""

from types import SimpleNamespace

import numpy as np

from orrery.llm import common, toxicity


def test_one_operator_keeps_nothing_of_another():
    common.forget()
    made = []
    make = lambda: made.append(1) or object()
    first = common.kept("a", 1, make)
    assert common.kept("a", 1, make) is first and len(made) == 1
    common.forget("a")
    assert common.kept("a", 1, make) is first
    assert common.kept("a", 2, make) is not first and len(made) == 2
    common.forget("b")
    assert not common._KEPT


def test_a_task_drops_what_others_have_kept(spark):
    """In the worker: a task of another operator finds nothing there, one of the same finds what it made."""

    def keeping(columns):
        common.kept("some", 0, lambda: np.zeros(10))
        yield (len(common._KEPT),)

    def looking(columns):
        yield (len(common._KEPT),)

    one = spark.range(1).repartition(1)
    assert [r[0] for r in common.map_batches(one, keeping, "n long", keeps="some").collect()] == [1]
    assert [r[0] for r in common.map_batches(one, looking, "n long").collect()] == [0]


def test_a_scorer_is_made_again_for_other_weights():
    shared = lambda: SimpleNamespace(value=(np.zeros(1 << 20), SimpleNamespace(drift=0.1)))
    a, b = shared(), shared()
    first = toxicity._scorer(a)
    assert toxicity._scorer(a) is first and first.weights is a.value[0]
    assert toxicity._scorer(b) is not first and toxicity._scorer(b).weights is b.value[0]
    common.forget()
