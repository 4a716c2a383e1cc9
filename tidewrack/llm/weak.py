"""Reliabilities of overlapping labelers from their votes alone."""

from __future__ import annotations

import math

ROUNDS = 50
#: Shares of votes (-1, 0, 1) where the truth is yes and where it is no, thought before the data speak ...
EITHER_WAY = ((0.15, 0.25, 0.6), (0.6, 0.25, 0.15))
#: ... of a labeler that looks for one defect and says nothing without it.
DETECTOR = ((0.01, 0.98, 0.01), (0.3, 0.69, 0.01))
#: Votes that this belief weighs.
WEIGHT = 20.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], labelers: list[tuple]) -> tuple[float, dict, dict]:
    """Expectation-maximisation over (votes, count): the share of yes, for truth 1 and 0 each
    labeler's probabilities of voting -1, 0, 1, and the posterior of yes for each pattern.
    Where every labeler is silent the posterior is the share."""
    before = {1: [b[0] for b in labelers], 0: [b[1] for b in labelers]}
    like = {t: [list(b) for b in before[t]] for t in (0, 1)}
    prior, spoken = 0.5, [(v, c) for v, c in patterns if any(v)]
    total = sum(c for _, c in spoken)
    post: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for votes, _count in spoken:
            gap = math.log(1 - prior) - math.log(prior)
            for i, v in enumerate(votes):
                gap += math.log(like[0][i][v + 1]) - math.log(like[1][i][v + 1])
            post[votes] = 1 / (1 + math.exp(min(50, max(-50, gap))))
        if not total:
            break
        prior = min(0.999, max(0.001, sum(post[v] * c for v, c in spoken) / total))
        for truth in (0, 1):
            for i in range(len(labelers)):
                mass = [WEIGHT * b for b in before[truth][i]]
                for v, c in spoken:
                    mass[v[i] + 1] += c * (post[v] if truth else 1 - post[v])
                like[truth][i] = [m / sum(mass) for m in mass]
    post.update({v: prior for v, _ in patterns if not any(v)})
    return prior, like, post
