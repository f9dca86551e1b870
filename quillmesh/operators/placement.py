"""Placement on a page: arrangements are judged together, and the first that does no harm is taken.

A page is one reader's list of cards. The passes that place single cards (exploration,
must-know floor, standing floors) all pose the same question: of these arrangements, in
order of preference, which is the first that neither breaks the repeat cap nor holds more
one-sided windows than before? `first_kept` answers it for a block of arrangements at a
time, as a matrix with a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

QUOTA_WINDOW, QUOTA_SHARE = 10, 0.6


class Page:
    """What arrangements are judged by: each card's lean, how good it is, and the repeat cap if there is one."""

    def __init__(self, leans: list[str | None], neutral: list[int], cap: Callable[[list[int]], bool] | None = None):
        names = {x: k for k, x in enumerate(sorted({x for x in leans if x}))}
        self.lean = np.array([names.get(x, -1) for x in leans], np.int64)
        self.sides, self.cap = len(names), cap
        # rank 0 is the best card: by neutral score, then number
        self.rank = np.empty(len(neutral), np.int64)
        self.rank[np.lexsort((np.arange(len(neutral)), -np.array(neutral, np.int64)))] = np.arange(len(neutral))

    def one_sided(self, orders: np.ndarray, window: int = QUOTA_WINDOW, share: float = QUOTA_SHARE) -> np.ndarray:
        """For each row, its windows that hold more of one lean than its share; a row shorter than a window is one."""
        shown = self.lean[orders]
        width = min(window, shown.shape[1])
        most = int(window * share + 1e-9)
        over = np.zeros((len(shown), shown.shape[1] - width + 1), bool)
        for side in range(self.sides):
            total = np.pad(np.cumsum(shown == side, axis=1), ((0, 0), (1, 0)))
            over |= total[:, width:] - total[:, : total.shape[1] - width] > most
        return over.sum(axis=1)

    def best_first(self, cards: Iterable[int]) -> list[int]:
        return sorted(cards, key=self.rank.__getitem__)


def first_kept(page: Page, before: np.ndarray, blocks: Iterable[np.ndarray]) -> tuple[int, int] | None:
    """(block, row) of the arrangement to take, or None where there is none.

    The first that keeps the cap and adds no one-sided window; else the first that keeps
    the cap; where none does, the first that adds no window; else the first.
    """
    allowed = page.one_sided(before[None])[0]
    best: tuple[tuple[bool, bool], tuple[int, int]] | None = None
    for b, block in enumerate(blocks):
        if not len(block):
            continue
        worse = page.one_sided(block) > allowed
        broken = np.array([not page.cap(row.tolist()) for row in block]) if page.cap else np.zeros(len(block), bool)
        k = int(np.lexsort((np.arange(len(block)), worse, broken))[0])
        harm = bool(broken[k]), bool(worse[k])
        if best is None or harm < best[0]:
            best = harm, (b, k)
        if harm == (False, False):
            break
    return best[1] if best else None


def moved(order: np.ndarray, cards: list[int], place: int) -> np.ndarray:
    """A row a card: the order with that card at the place, the others as they were."""
    rows = []
    for card in cards:
        rest = order[order != card]
        rows.append(np.concatenate([rest[:place], [card], rest[place:]]))
    return np.array(rows, np.int64).reshape(len(rows), len(order))


def traded(order: np.ndarray, card: int, places: list[int], below: range) -> np.ndarray:
    """All trades of a card, a row each: it takes one of the places, and who stood there goes to one below."""
    at = int(np.flatnonzero(order == card)[0])
    rows = np.empty((len(places) * len(below), len(order)), np.int64)
    k = 0
    for place in places:
        rest = np.delete(order, at)
        rest[place] = card
        for to in below:
            rows[k] = np.insert(rest, to, order[place])
            k += 1
    return rows


def explored(page: Page, order: list[int], slots: Iterable[int]) -> list[int]:
    """Each slot takes the best card at or below it that no slot has taken yet."""
    now, taken = np.array(order, np.int64), set()
    for slot in sorted(s for s in slots if 1 <= s <= len(order)):
        cards = page.best_first(set(now[slot - 1 :].tolist()) - taken)
        ways = moved(now, cards, slot - 1)
        if (found := first_kept(page, now, [ways])) is not None:
            now = ways[found[1]]
            taken.add(cards[found[1]])
    return now.tolist()


def with_floor(page: Page, order: list[int], wanted: list[bool], places: int) -> list[int]:
    """Wanted cards fill the first places, those that are there already first, then the best from below."""
    now = np.array(order, np.int64)
    want = np.array(wanted, bool)[now] if len(now) else np.zeros(0, bool)
    within = np.arange(len(now)) < places
    now = np.concatenate([now[within & want], now[~(within & want)]])
    filled = int((within & want).sum())
    left = page.best_first(np.array(order, np.int64)[want & ~within].tolist())
    while filled < places and left:
        ways = moved(now, left, filled)
        _, k = first_kept(page, now, [ways])
        now = ways[k]
        del left[k]
        filled += 1
    return now.tolist()


def with_standing(page: Page, order: list[int], floors: Iterable[tuple[set[int], int, int]], held: set[int]) -> list[int]:
    """Each floor, (cards that qualify, places, within), has its places near the top.

    A card from below trades with one of the zone that nothing holds. Preferred are the
    best card, then the lowest place, then the nearest place below for the card that
    leaves. What a floor counts is held from then on.
    """
    now, held = np.array(order, np.int64), set(held)
    for fits, places, within in floors:
        within = min(within, len(now))
        zone = [c for c in now[:within].tolist() if c in fits]
        held.update(zone[:places])
        for _ in range(places - len(zone)):
            below = page.best_first(c for c in now[within:].tolist() if c in fits)
            free = [p for p in range(within - 1, -1, -1) if int(now[p]) not in held]
            if not below or not free:
                break
            tried: list[np.ndarray] = []

            def ways(now=now, below=below, free=free, within=within, tried=tried):
                for card in below:
                    at = int(np.flatnonzero(now == card)[0])
                    tried.append(traded(now, card, free, range(within, at + 1)))
                    yield tried[-1]

            block, k = first_kept(page, now, ways())
            now = tried[block][k]
            held.add(below[block])
    return now.tolist()
