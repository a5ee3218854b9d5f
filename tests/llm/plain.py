"""Plain versions of the scores, without automata, prefix sums or scaling."""

import math

import numpy as np

from codeweft.llm import quality, toxicity


def toxic_score(lexicon, text):
    words = toxicity.WORD.findall(toxicity.folded(text or ""))
    n, rests = len(words), [" ".join(words[k : k + 8]) for k in range(len(words))]
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    calm = [(starts[k], starts[k] + len(p)) for k in range(n) for p in lexicon.exceptions if rests[k].startswith(p)]
    found = [(k, w) for k in range(n) for s, w in lexicon.stems.items() if words[k].startswith(s) and not any(a <= starts[k] and starts[k] + len(s) <= b for a, b in calm)]
    mean, square = lexicon.chance

    def excess(weight, m):
        return (weight - mean * m) / math.sqrt((1 + math.log(1 + m) / 4) ** 2 + (toxicity.SPREAD**2) * square * m + (toxicity.SPREAD * toxicity.DOUBT * mean * m) ** 2)

    best, size = excess(sum(w for _, w in found), n), toxicity.PASSAGE
    while found and size < n:
        best = max(best, *(excess(sum(w for j, w in found if k <= j < k + size) - math.log(n / size), size) for k, _ in found))
        size *= 2
    a, b = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * best)))


def quality_score(chain, text):
    """Forward-backward in logarithms, one matrix of both labels at a time."""
    x, lengths = quality.features(text or "")
    share = 0.5
    if len(x):
        own = np.stack([np.zeros(len(x)), np.clip(x @ chain.weights, -30, 30)], 1)
        ahead, back = [own[0]], [np.zeros(2)]
        for u in own[1:]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + chain.moves, axis=0) + u)
        for u in own[:0:-1]:
            back.append(np.logaddexp.reduce(chain.moves + (u + back[-1])[None, :], axis=1))
        both = np.array(ahead) + np.array(back[::-1])
        good = np.exp(both[:, 0] - np.logaddexp(both[:, 0], both[:, 1]))
        share = float((good * lengths).sum() / lengths.sum())
    a, b = chain.curve
    return 1 / (1 + math.exp(-(a + b * share)))
