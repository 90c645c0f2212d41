"""A packing plan from a histogram of lengths: linear grouping, configurations, substitution, best fit.

Lengths are integers up to the capacity, so the plan depends on capacity numbers only, whatever the number of
documents, and it is made of runs of equal bins. It works on:

1. Large lengths in descending order, dealt into GROUPS groups of equal cardinality; each counts as its group's largest.
2. Configurations of the few rounded sizes: the linear program over all of them, by column generation (a knapsack per
   step). Solutions are rounded down to whole numbers of bins.
3. The actual lengths of a group take its places, so that bins have room left.
4. What is left, large or small, goes by best fit in descending order, into new bins where none has room.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np

GROUPS = 64
#: What share of the capacity makes a length large: each is tried, and the plan with the fewest bins is taken.
LARGE = (0.5, 0.34, 0.25)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 600) -> list[tuple[np.ndarray, int]]:
    """(places for each size, number of bins): an optimum of the linear program, rounded down."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amounts = demand / np.diag(basis)
    for _ in range(most_steps):
        value = np.linalg.solve(basis.T, np.ones(n))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.argsort(sizes)
        ordered, worth = sizes[order], value[order]
        for c in range(int(ordered[0]), capacity + 1):
            k = int(np.searchsorted(ordered, c, "right"))
            got = best[c - ordered[:k]] + worth[:k]
            top = int(np.argmax(got))
            if got[top] > best[c - 1] + 1e-12:
                best[c], choice[c] = got[top], order[top]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= int(sizes[choice[c]])
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(np.argmin(ratio))
        step = ratio[leaving]
        amounts = np.maximum(amounts - step * change, 0)
        amounts[leaving], basis[:, leaving] = step, column
    return [(basis[:, k].astype(int), int(amounts[k] + 1e-6)) for k in range(n) if amounts[k] + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> tuple[np.ndarray, int]:
    """The best of the plans for these thresholds; one that is within a thousandth of the lower bound ends the search."""
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: tuple[np.ndarray, int] | None = None
    for share in large:
        found = grouped_plan(histogram, capacity, groups, share)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= least * 1.001:
            break
    return best


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, number, first bin, offset), sorted: the k-th document of the run goes to the k-th bin
    from the first, at that offset; and the number of bins. histogram: number of documents of each length from 1 to capacity."""
    rows: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}

    def place(length: int, number: int, first: int, offset: int) -> None:
        rows.append((length, used[length], number, first, offset))
        used[length] += number

    big = sorted((x for x in histogram if x > large * capacity and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in big)
    queues: dict[int, deque[list[int]]] = {}
    each, left, current = max(1, -(-total // groups)), 0, 0
    for length in big:
        rest = histogram[length]
        while rest:
            if not left:
                left, current = each, length
                queues.setdefault(current, deque())
            take = min(rest, left)
            queues[current].append([length, take])
            rest, left = rest - take, left - take
    sizes = np.array(sorted(queues, reverse=True), int)
    if len(sizes):
        demand = np.array([sum(n for _, n in queues[s]) for s in sizes], float)
        for places, number in sorted(_configurations(sizes, demand, capacity), key=lambda x: x[0].tolist(), reverse=True):
            slots = [queues[int(s)] for s, k in zip(sizes, places, strict=True) for _ in range(k)]
            number = min([number, *(sum(n for _, n in queues[int(s)]) // int(k) for s, k in zip(sizes, places, strict=True) if k)])
            # Places of one size take documents from both ends of the group, so that long ones meet short ones.
            while number:
                ends = [(q, 0 if k % 2 == 0 else -1) for k, q in enumerate(slots)]
                run = number
                for q in {id(q): q for q in slots}.values():
                    heads = [q[e][1] for o, e in ends if o is q]
                    same = len(q) == 1 or len({e for o, e in ends if o is q}) == 1
                    run = min(run, min(heads) // len(heads) if same else min(q[e][1] // sum(1 for o, f in ends if o is q and f == e) for e in (0, -1)))
                if run:
                    offset = 0
                    for q, e in ends:
                        place(q[e][0], run, bins, offset)
                        offset += q[e][0]
                        q[e][1] -= run
                else:  # one bin that takes the last of a length and the first of the next
                    run, offset = 1, 0
                    for q, e in ends:
                        while not q[e][1]:
                            q.popleft() if e == 0 else q.pop()
                        place(q[e][0], 1, bins, offset)
                        offset += q[e][0]
                        q[e][1] -= 1
                for q in slots:
                    while q and not q[0][1]:
                        q.popleft()
                    while q and not q[-1][1]:
                        q.pop()
                room.setdefault(capacity - offset, []).append((bins, run))
                bins, number = bins + run, number - run
    free = sorted(r for r in room if r)
    for length in sorted(histogram, reverse=True):
        rest = histogram[length] - used[length]
        while rest:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                space = free[k]
                first, number = room[space].pop()
                run = min(rest, number)
                if run < number:
                    room[space].append((first + run, number - run))
                if not room[space]:
                    free.pop(k)
                place(length, run, first, capacity - space)
                rest -= run
                new = [(space - length, first, run)]
            else:
                fit = capacity // length
                run, most = (rest // fit, fit) if rest >= fit else (1, rest)
                for j in range(most):
                    place(length, run, bins, j * length)
                rest -= run * most
                new = [(capacity - most * length, bins, run)]
                bins += run
            for space, first, run in new:
                if space:
                    if not room.get(space):
                        room[space] = []
                        bisect.insort(free, space)
                    room[space].append((first, run))
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins
