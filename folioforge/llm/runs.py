"""Links that join components within one run of sets, by differences to a reference.

Sets of sizes n and m link when they differ in at most apart(n, m) members, and two
sets differ just where their differences to a third set do.  So near-copies of one
text are compared by how each departs from what most of them hold:

1. Two sets whose differences to the reference count apart(n, m) together, or fewer,
   link whatever these are.  Sets of equal size and equal count do so alike, so a few
   edges connect them all.
2. Any others share a difference, the first of them, rarest first, among the first
   apart + 1 of either.  They meet in the postings of those only, pass the position
   filter, and are verified on all of their differences.

A reference is given the sets near it; they meet each other and what lies within reach,
then the next reference takes the rest.  The choice of references decides how much
is compared, never what is found.  Sets that are in one component already are not
compared, and of the links found those come out that join components.
"""

from __future__ import annotations

import numpy as np

from .components import local_roots

REFERENCES = 16
SMALL = 200  # runs of so few sets have one reference
WORK = 500_000


def spans(size: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in a row."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Run:
    """The sets of a run: sizes n, roots, and their members by `end`, the running
    sum of n.  With `side`, sets of one side need not meet."""

    def __init__(self, rule, n: np.ndarray, root: np.ndarray, members: np.ndarray, side: np.ndarray | None = None):
        self.rule, self.n, self.side = rule, n, side
        self.row = np.repeat(np.arange(len(n)), n)
        self.member = np.unique(members, return_inverse=True)[1]
        self.of = np.unique(root, return_inverse=True)[1]
        # sizes of linked sets are within num / den, so this bounds every apart()
        self.most = (n + n * rule.den // rule.num) * (rule.den - rule.num) // (rule.num + rule.den)
        self.found: list[np.ndarray] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes up links, keeping those that join components: each round one for
        each component at most."""
        while True:
            open_ = self.of[i] != self.of[j]
            i, j = i[open_], j[open_]
            if not len(i):
                return
            first = np.unique(self.of[i], return_index=True)[1]
            self.found.append(np.stack([i[first], j[first]], axis=1))
            self.of = local_roots(self.of[i[first]], self.of[j[first]], int(self.of.max()) + 1)[self.of]

    def links(self) -> np.ndarray:
        """Rows (i, j): links that connect whatever links of the run connect."""
        rest = np.ones(len(self.n), bool)
        leader = None
        for _ in range(REFERENCES if len(rest) > SMALL else 0):
            if self._settled(rest):
                break
            usual = self._usual(rest if leader is None else self._near(leader, rest))
            away = self._away(usual)
            core = rest & (away <= 2 * self.most)
            if leader is not None:
                core[leader] = True
            if core.any():
                reach = int(away[core].max()) + int(self.most[core].max())
                self._settle(usual, rest & (away <= reach), core)
                rest &= ~core
            if rest.any():  # a set of middling size leads next
                left = np.flatnonzero(rest)
                leader = left[np.argsort(self.n[left], kind="stable")[len(left) // 2]]
        if not self._settled(rest):
            self._settle(self._usual(rest), rest, rest)
        return np.concatenate(self.found) if self.found else np.zeros((0, 2), np.int64)

    def _settled(self, rest: np.ndarray) -> bool:
        of = self.of[rest]
        return len(of) < 2 or of.min() == of.max()

    def _usual(self, rows: np.ndarray) -> np.ndarray:
        """Members of more than half of the rows, as flags."""
        return 2 * np.bincount(self.member[rows[self.row]], minlength=int(self.member.max()) + 1) > rows.sum()

    def _away(self, usual: np.ndarray) -> np.ndarray:
        """In how many members each set differs from the reference."""
        held = np.bincount(self.row, usual[self.member], minlength=len(self.n)).astype(np.int64)
        return self.n + int(usual.sum()) - 2 * held

    def _near(self, leader: int, rest: np.ndarray) -> np.ndarray:
        own = np.zeros(int(self.member.max()) + 1, bool)
        own[self.member[self.row == leader]] = True
        near = rest & (self._away(own) <= 2 * self.most)
        near[leader] = True
        return near

    def _settle(self, usual: np.ndarray, rows: np.ndarray, core: np.ndarray) -> None:
        """Finds the links between `core` and `rows`, through their differences."""
        at = np.flatnonzero(rows)
        place = np.full(len(self.n), -1)
        place[at] = np.arange(len(at))
        here = rows[self.row]
        row, member = place[self.row[here]], self.member[here]
        common = np.flatnonzero(usual)
        slot = np.full(len(usual), -1)
        slot[common] = np.arange(len(common))
        lacks = np.ones((len(at), len(common)), bool)
        hit = usual[member]
        lacks[row[hit], slot[member[hit]]] = False
        lack_row, lack = np.nonzero(lacks)
        row, what = np.concatenate([row[~hit], lack_row]), np.concatenate([member[~hit], common[lack]])
        often = np.bincount(what, minlength=len(usual))
        rank = np.empty(len(usual), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(usual))
        order = np.lexsort((rank[what], row))
        row, what = row[order], rank[what[order]]
        d = np.bincount(row, minlength=len(at))
        begin = np.cumsum(d) - d
        self._few(at, d)

        pos = np.arange(len(row)) - begin[row]
        use = (pos <= self.most[at[row]]) & (np.sort(often)[what] > 1)
        p_row, p_pos, p_what = row[use], pos[use], what[use]
        order = np.argsort(p_what, kind="stable")
        p_row, p_pos, p_what = p_row[order], p_pos[order], p_what[order]
        later = np.searchsorted(p_what, p_what, side="right") - np.arange(len(p_what)) - 1
        done = np.cumsum(later)
        x = 0
        while x < len(later):
            y = max(x + 1, int(np.searchsorted(done, (done[x - 1] if x else 0) + WORK, side="right")))
            i = np.repeat(np.arange(x, y), later[x:y])
            j = i + 1 + spans(later[x:y])
            x = y
            a, b = p_row[i], p_row[j]
            ok = (self.of[at[a]] != self.of[at[b]]) & (core[at[a]] | core[at[b]])
            if self.side is not None:
                ok &= self.side[at[a]] != self.side[at[b]]
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            u, v = p_pos[i], p_pos[j]
            ok = u + v + np.abs(d[a] - u - d[b] + v) <= self.rule.apart(self.n[at[a]], self.n[at[b]])
            pair = np.unique(np.minimum(a[ok], b[ok]) * len(at) + np.maximum(a[ok], b[ok]))
            self._verify(at, pair // len(at), pair % len(at), what, begin, d)

    def _few(self, at: np.ndarray, d: np.ndarray) -> None:
        """Links of sets that differ so little from the reference that they must link."""
        low = np.flatnonzero(d <= self.most[at])
        kind, first, which, many = np.unique(np.stack([d[low], self.n[at[low]]], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        which = which.reshape(-1)
        members = np.split(low[np.argsort(which, kind="stable")], np.cumsum(many)[:-1])
        whole = np.zeros(len(kind), bool)  # all sets of the kind are tied to one

        def tie(one: int, sets: np.ndarray) -> None:
            self.join(at[np.full(len(sets), one)], at[sets])

        for x in range(len(kind)):
            y = np.flatnonzero(kind[x:, 0] + kind[x, 0] <= self.rule.apart(kind[x:, 1], kind[x, 1])) + x
            if not len(y):
                continue
            head = members[x][0]
            tie(head, low[first[y]])
            for z in y[~whole[y]].tolist():
                tie(head, members[z])
            whole[y] = True
            if not whole[x]:
                tie(members[y[0]][0], members[x])
                whole[x] = True

    def _verify(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, what: np.ndarray, begin: np.ndarray, d: np.ndarray) -> None:
        done = np.cumsum(d[a] + d[b])
        x = 0
        while x < len(a):
            y = max(x + 1, int(np.searchsorted(done, (done[x - 1] if x else 0) + WORK, side="right")))
            i, j = a[x:y], b[x:y]
            x = y
            open_ = self.of[at[i]] != self.of[at[j]]
            i, j = i[open_], j[open_]
            key = np.concatenate([np.repeat(np.arange(len(i)), d[r]) * (int(what.max(initial=0)) + 1) + what[np.repeat(begin[r], d[r]) + spans(d[r])] for r in (i, j)])
            key.sort()
            twin = key[1:][key[1:] == key[:-1]]
            shared = np.bincount(twin // (int(what.max(initial=0)) + 1), minlength=len(i))
            ok = d[i] + d[j] - 2 * shared <= self.rule.apart(self.n[at[i]], self.n[at[j]])
            self.join(at[i[ok]], at[j[ok]])
