"""The rate limit stream takes a key's events in pieces (ST3)."""

from __future__ import annotations

import weakref

import numpy as np
import pandas as pd

from engram.streaming.streams import _rate_fn


class State:
    exists, hasTimedOut, value = False, False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def walk(events, n, window, state=(0, None, None)):
    count, reset, start = state
    out = []
    for t, e in sorted(events):
        if reset is None or t > reset:
            count, reset, start = 1, t + window, t
            out.append((e, t, True, start))
        else:
            out.append((e, t, count < n, start))
            count += count < n
    return out, (count, reset, start)


def test_frames_of_a_key_are_not_held_together():
    rng = np.random.default_rng(1)
    state, before, number = State(), (0, None, None), 0
    for batch in range(3):  # the window goes on from batch to batch, also amid ties
        t = np.sort(rng.integers(batch * 5000, (batch + 1) * 5000, 20_000))
        rng.shuffle(t)
        ids = np.arange(number, number + len(t))
        number += len(t)
        alive: dict[int, weakref.ref] = {}
        most = 0

        def frames():
            nonlocal most
            for k in range(0, len(t), 100):
                pdf = pd.DataFrame({"key": "a", "t": t[k:k + 100], "event_id": ids[k:k + 100]})
                alive[k] = weakref.ref(pdf, lambda _, k=k: alive.pop(k))
                most = max(most, len(alive))
                yield pdf

        got, longest = [], 0
        for pdf in _rate_fn(5, 300, None)(("a",), frames(), state) if batch == 0 else _rate_fn(5, 300, None, 1000)(("a",), frames(), state):
            longest = max(longest, len(pdf))
            got += list(pdf[["event_id", "t", "accepted", "window_start"]].itertuples(index=False, name=None))
        want, before = walk(list(zip(t.tolist(), ids.tolist())), 5, 300, before)
        assert got == want
        assert state.value == before
        assert most < 10 and longest <= 10_000


def test_many_events_of_one_second():
    t = [7] * 5000 + [6] + [8] * 3000
    pdf = pd.DataFrame({"key": "a", "t": t, "event_id": np.arange(len(t))[::-1]})
    state = State()
    got = [r for f in _rate_fn(3, 0, None, 500)(("a",), (pdf[k:k + 300] for k in range(0, len(pdf), 300)), state)
           for r in f[["event_id", "t", "accepted", "window_start"]].itertuples(index=False, name=None)]
    assert got == walk(list(zip(pdf["t"].tolist(), pdf["event_id"].tolist())), 3, 0)[0]
