import pytest

from tracelake.plans.filterlang import FilterError, Leaf, Node, built, compile_filter, joined, parse


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, k % 3, k * 10, "kernel", "irq" if k % 2 else "sched", "my name" if k == 3 else "x", 12_500_000_000 + k) for k in range(12)]
    return spark.createDataFrame(rows, "id long, cpu long, pid long, channel string, event_name string, process_name string, time_ns long")


def ids(events, text, **options):
    return [r.id for r in events.where(compile_filter(text, columns=set(events.columns), **options)).orderBy("id").collect()]


def test_comparisons(events):
    assert ids(events, "state.pid>=30 & state.pid<60") == [3, 4, 5]
    assert ids(events, 'state.process_name = "my name"') == ids(events, "state.process_name=my name") == [3]
    assert ids(events, "event.name=kernel.irq & state.cpu!=0") == [1, 5, 7, 11]
    assert ids(events, "event.time > 12.500000009") == [10, 11]
    assert ids(events, "!(state.pid<100 | state.cpu=1)") == [11]
    assert ids(events, "state.ppid = 5") == list(range(12))


def test_precedence():
    a, b, c = (Leaf(f"state.{x}", "=", "1") for x in ("pid", "cpu", "ppid"))
    text = "state.pid=1 & state.cpu=1 | state.ppid=1"
    assert parse(text) == Node("|", Node("&", a, b), c)
    assert parse(text, compat=True) == Node("&", a, Node("|", b, c))
    assert parse(text.replace("&", "&&").replace("|", "||")) == parse(text)


def test_compat(events):
    every = list(range(12))
    assert ids(events, "state.pid=10 || state.pid=20", compat=True) == every and ids(events, "state.pid=10 || state.pid=20") == [1, 2]
    assert ids(events, "!(state.pid=10 | state.pid=20)", compat=True) == every
    assert ids(events, "event.time >= 12.500000010", compat=True) == [10, 11]


def test_errors():
    for bad in ("state.pid", "state.pid=", "(state.pid=1", "state.pid=x", "nothing=1", 'state.pid="1', "state.process_name<3", "event.time=x"):
        with pytest.raises(FilterError):
            compile_filter(bad)


def test_building(events):
    assert joined(["state.pid=1", "", "state.cpu=2"]) == "(state.pid=1)&(state.cpu=2)"
    assert ids(events, built([("state.pid", ">", "90", "&"), ("state.cpu", "=", "1", "")])) == [10]
