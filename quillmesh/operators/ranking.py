"""Ranking: integer score terms with an exact sum, and the ordered list passes.

Terms are column expressions. A pass reorders one reader's page, a list of bounded length,
so passes run per list by applyInPandas, lists over the cluster.
"""

from __future__ import annotations

from collections import Counter, deque
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.numeric import micro

from .placement import QUOTA_SHARE, QUOTA_WINDOW, Page, explored, moved, with_floor, with_standing

CAP, EXTRA = 1.0, 0.25
REPEAT_WINDOW, REPEAT_MAX = 12, 2
SLOTS = (4, 14, 24)


def affinity(weights: Column) -> Column:
    """The strongest matched topic in full, the others at a quarter, capped."""
    strongest = F.coalesce(F.array_max(weights), F.lit(0.0))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(CAP), strongest + EXTRA * (total - strongest))


def score_terms(stories: DataFrame, now_s: int, half_life: float = 12.0) -> DataFrame:
    """Stories with recency, affinity, importance, trust and score, all Long micro-points.

    stories: latest_s, weights (array of double), independent, trust (double).
    """
    age = F.greatest(F.lit(0.0), (F.lit(now_s) - F.col("latest_s")) / 3600.0)
    out = stories.withColumn("recency", micro(F.round(F.pow(F.lit(2.0), -age / half_life), 9))).withColumn("affinity", micro(affinity(F.col("weights")))).withColumn("importance", micro(F.round(0.5 * F.log2(F.greatest(F.lit(1.0), F.col("independent").cast("double"))), 9)))
    base = F.col("recency") + F.col("affinity") + F.col("importance")
    out = out.withColumn("trust_term", F.floor((F.col("trust") - 1) * base + 0.5).cast("long"))
    return out.withColumn("score", base + F.col("trust_term"))


def breaks(leans: list[str | None], window: int = QUOTA_WINDOW, share: float = QUOTA_SHARE) -> int:
    """Windows that hold more of one lean than its share."""
    return int(Page(leans, [0] * len(leans)).one_sided(np.arange(len(leans))[None], window, share)[0])


def lean_quota(leans: list[str | None], window: int = QUOTA_WINDOW, share: float = QUOTA_SHARE) -> list[int]:
    """The order in which positions are placed so that no window holds more than its share of one lean.

    Each lean has a queue of its own; the next place goes to the earliest head whose lean
    is below its cap in the last places, or to the earliest head where none is.
    """
    cap, out = int(window * share + 1e-9), []
    queues: dict[str | None, deque[int]] = {}
    for i, lean in enumerate(leans):
        queues.setdefault(lean or None, deque()).append(i)
    last, held = deque(), Counter()
    while queues:
        free = [q[0] for lean, q in queues.items() if lean is None or held[lean] < cap]
        i = min(free or [q[0] for q in queues.values()])
        lean = leans[i] or None
        queues[lean].popleft()
        if not queues[lean]:
            del queues[lean]
        out.append(i)
        last.append(lean)
        held[lean] += 1
        if len(last) >= window:
            held[last.popleft()] -= 1
    return out


def rare_words(words: list[set[str]]) -> list[set[str]]:
    """Each card's words that few cards have: two, or one in fifty."""
    df = Counter(chain.from_iterable(words))
    most = max(2, len(words) // 50)
    return [{w for w in ws if df[w] <= most} for ws in words]


class Top:
    """Cards at the top of a page, by event and by rare word, to tell which others may join them."""

    def __init__(self, events: list, rare: list[set[str]], most: int = REPEAT_MAX):
        self.events, self.rare, self.most = events, rare, most
        self.per_event, self.by_word = Counter(), {}

    def takes(self, i: int) -> bool:
        """Whether card i is neither over its event's cap nor a twin of one that is here."""
        if self.events[i] is not None and self.per_event[self.events[i]] >= self.most:
            return False
        common = Counter(chain.from_iterable(self.by_word.get(w, ()) for w in self.rare[i]))
        return all(2 * n <= min(len(self.rare[i]), len(self.rare[k])) for k, n in common.items())

    def add(self, i: int) -> None:
        if self.events[i] is not None:
            self.per_event[self.events[i]] += 1
        for w in self.rare[i]:
            self.by_word.setdefault(w, []).append(i)


def repeat_cap(events: list, words: list[set[str]], window: int = REPEAT_WINDOW, most: int = REPEAT_MAX) -> list[int]:
    """Cards over the cap of their event, or that share most rare headline words with one above, leave the top."""
    everyone = range(len(events))
    if len(events) <= window:
        return list(everyone)
    top, first = Top(events, rare_words(words), most), {}
    for i in everyone:
        if len(first) < window and top.takes(i):
            top.add(i)
            first[i] = True
    return [*first, *(i for i in everyone if i not in first)]


def cap_holds(order: list[int], events: list, rare: list[set[str]], window: int = REPEAT_WINDOW) -> bool:
    """Whether the top of an order keeps the repeat cap."""
    top = Top(events, rare)
    for i in order[:window]:
        if not top.takes(i):
            return False
        top.add(i)
    return True


def at_place(order: list[int], i: int, place: int) -> list[int]:
    """`order` with i at a place from 0, the others as they were."""
    return moved(np.array(order, np.int64), [i], place)[0].tolist()


def explore(order: list[int], neutral: list[int], leans: list[str | None], events: list | None = None, rare: list[set[str]] | None = None, slots: tuple[int, ...] = SLOTS) -> list[int]:
    """Each slot takes the best story at or below it by neutral score, with care for the repeat cap and the lean quota."""
    cap = None if events is None else lambda o: cap_holds(o, events, rare)
    return explored(Page(leans, neutral, cap), order, slots)


def floor_pass(order: list[int], must: list[bool], neutral: list[int], leans: list[str | None], places: int) -> list[int]:
    """Must-know stories fill the first places; `must` goes by card."""
    return with_floor(Page(leans, neutral), order, must, places)


def standing_floor(order: list[int], standing: list[tuple[set[int], int, int]], neutral: list[int], leans: list[str | None], held: set[int]) -> list[int]:
    """Each standing story, (cards that qualify, places, within), has its places near the top. `held`: cards that stay put."""
    return with_standing(Page(leans, neutral), order, standing, held)


def run_passes(pages: DataFrame, standing: list[tuple[str, int, int]] = (), must_places: int = 3) -> DataFrame:
    """(list_id, id, place): each list by score, then repeat cap, lean quota, exploration, must-know and standing floors.

    pages: list_id, id, score, neutral (Long), event, lean, words (array), must_know and
    topics (array). standing: (topic, places, within). A list is one reader's page: some
    hundred cards, whatever the table's size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        none = lambda x: None if x is None or x != x else x
        leans, events, neutral = [none(x) for x in pdf["lean"]], [none(x) for x in pdf["event"]], pdf["neutral"].tolist()
        words = [set(w) for w in pdf["words"]]
        order = repeat_cap(events, words)
        order = [order[k] for k in lean_quota([leans[i] for i in order])]
        explored = explore(order, neutral, leans, events, rare_words(words))
        order = floor_pass(explored, pdf["must_know"].tolist(), neutral, leans, must_places)
        held = {explored[x - 1] for x in SLOTS if x <= len(explored)} | set(order[:must_places])
        order = standing_floor(order, [({i for i, t in enumerate(pdf["topics"]) if topic in t}, places, within) for topic, places, within in standing], neutral, leans, held)
        return pd.DataFrame({"list_id": pdf["list_id"].iloc[order].to_numpy(), "id": pdf["id"].iloc[order].to_numpy(), "place": range(1, len(order) + 1)})

    return pages.groupBy("list_id").applyInPandas(run, "list_id long, id long, place int")


def select_pool(candidates: DataFrame, budget: int, floor: int = 2, ceiling: int = 12, extra_penalty: int = 8) -> DataFrame:
    """(run_id, id, why): source floors first, then a greedy fill by score under ceilings and a byte budget.

    candidates: run_id, id, source_id, cluster_id, points, bytes. One run's candidates are
    a few thousand rows; runs spread over the cluster.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["id", "source_id", "cluster_id", "points", "bytes"]].itertuples(index=False), key=lambda r: (-r.points, r.id))
        used, why, per_source, per_cluster = 0, {}, {}, {}

        def take(r, reason: str) -> None:
            nonlocal used
            used += r.bytes
            why[r.id] = reason
            per_source[r.source_id] = per_source.get(r.source_id, 0) + 1
            per_cluster[r.cluster_id] = per_cluster.get(r.cluster_id, 0) + 1

        for r in rows:
            if per_source.get(r.source_id, 0) < floor and used + r.bytes <= budget:
                take(r, "floor_source")
        left = [r for r in rows if r.id not in why]
        while left:
            worth = lambda r: r.points - extra_penalty * per_cluster.get(r.cluster_id, 0)
            left = [r for r in left if per_source.get(r.source_id, 0) < ceiling and used + r.bytes <= budget]
            if not left:
                break
            best = min(left, key=lambda r: (-worth(r), r.id))
            take(best, "fill")
            left.remove(best)
        run_id = pdf["run_id"].iloc[0]
        return pd.DataFrame([(run_id, i, w) for i, w in why.items()], columns=["run_id", "id", "why"])

    return candidates.groupBy("run_id").applyInPandas(run, "run_id long, id long, why string")
