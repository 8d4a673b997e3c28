"""Waiting rows by time bucket."""

import random

from askmill.streaming.state import BUCKET, WaitingRows


class Parts:
    """A map state that counts what is read and written."""

    def __init__(self):
        self.rows, self.read, self.written = {}, 0, 0

    def getValue(self, key):
        self.read += len(self.rows[key][0])
        return self.rows[key]

    def updateValue(self, key, value):
        assert key not in self.rows
        self.written += len(value[0])
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_every_row_is_taken_once_and_in_time():
    draw = random.Random(3)
    parts, kept, now, number = Parts(), (None, -1), 0, 0
    given, taken = [], []
    for _ in range(60):
        rows = []
        for _ in range(draw.randrange(40)):
            number += 1
            rows.append((now + 1 + draw.randrange(6 * BUCKET), number))
        given += rows
        waiting = WaitingRows(parts, *kept)
        waiting.add(rows)
        now += draw.randrange(2 * BUCKET)
        got = waiting.due(now)
        assert all(ts <= now for ts, _ in got)
        taken += got
        assert sorted(taken) == sorted(r for r in given if r[0] <= now)
        left = [ts for ts, _ in given if ts > now]
        assert waiting.first == min(left, default=None)
        kept = ({str(k): list(v) for k, v in waiting.held.items()}, waiting.taken)
    assert parts.written == len(given)


def test_reads_do_not_grow_with_the_rows_held():
    def reads(ahead):
        parts = Parts()
        waiting = WaitingRows(parts, None, -1)
        waiting.add([(1 + b * BUCKET, b) for b in range(1, ahead)])
        for batch in range(1, 50):
            waiting.add([(batch * 10, -batch)])
            waiting.due(batch * 10)
        return parts.read, parts.written - ahead

    assert reads(100)[0] == reads(100_000)[0]
    assert reads(100)[1] == reads(100_000)[1]


def test_a_table_taken_in_at_once_lies_in_few_buckets():
    start = 1_704_067_200_000
    rows = [(start + 7 * BUCKET * n, n) for n in range(2000)]
    parts = Parts()
    waiting = WaitingRows(parts, None, 0)
    waiting.add(rows)
    assert len(parts.rows) <= 4
    assert sorted(waiting.due(rows[-1][0])) == rows
    assert not parts.rows and waiting.first is None


def test_the_rest_of_a_wide_bucket_moves_to_narrower_ones():
    start = 1_704_067_200_000
    rows = [(start + 7 * BUCKET * n, n) for n in range(2000)]
    parts = Parts()
    waiting = WaitingRows(parts, None, 0)
    waiting.add(rows)
    taken = []
    for n in range(0, 2000, 10):
        waiting = WaitingRows(parts, {str(k): list(v) for k, v in waiting.held.items()}, waiting.taken)
        taken += waiting.due(rows[n][0])
        assert sorted(taken) == rows[: n + 1]
        assert waiting.first == rows[n + 1][0]
    # a row moves a few times, however often the watermark moves
    assert parts.written <= 4 * len(rows) and parts.read <= 8 * len(rows)
