"""How often keyed state asks the state's server: by key and batch, not by row."""

from docweft.streaming.keyed import Deliveries, Watchdog


class State:
    """A value or list state that counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.held, self.values = calls, None, []

    def get(self):
        self.calls.append("get")
        return self.held if not self.values else iter(self.values)

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None


class Seen(State):
    def get(self):
        self.calls.append("get")
        return iter(self.values)

    def appendValue(self, value):
        self.calls.append("append")
        self.values.append(value)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, *_):
        return State(self.calls)

    def getListState(self, *_):
        return Seen(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_watchdog_has_one_timer_a_key():
    dog, handle, hour = Watchdog({"open": 60}), Handle(), 3_600_000
    dog.init(handle)
    rows = [{"_at": i * 10 * hour * 1000, "_tie": i, "_status": "open"} for i in range(20)]
    assert list(dog.handleInputRows(("k",), iter(rows), Times(0))) == [] and len(handle.calls) == 3
    found = []
    while handle.timers:  # each that passes sets the next
        at = handle.timers.pop()
        found += dog.handleExpiredTimer(("k",), Times(at), None)
    assert [r["at"] for r in found] == [r["_at"] for r in rows] and dog.open.held is None


def test_deliveries_ask_once_a_batch():
    machine, handle = Deliveries(10, 48), Handle()
    machine.init(handle)
    rows = [{"event_id": i, "_at": i, "action": "claim", "message_id": None} for i in range(50)]
    assert len(list(machine.handleInputRows((1, "c"), iter(rows), None))) == 50
    assert len(handle.calls) <= 6
    assert list(machine.handleInputRows((1, "c"), iter(rows), None)) == []
