"""Linear-chain conditional random field with two states, clean and toxic, in numpy.

With two states a chain is a recurrence of odds: the forward odds x of state 1 become
E * (t01 + t11 x) / (t00 + t10 x), where E is the token's emission odds. All sequences of
a batch step together, longest first, so the work per step is a few vector operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np

# Fixed value: words as the contracts name them.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}

LEAST_WEIGHT = 0.02
_LIMIT = 1e30
STEMS = (3, 4, 5, 6, 7, 8)
FEATURES_HERE, FEATURES_BESIDE = 4 + len(STEMS), 2


def is_listed(word: str, lexicon: frozenset[str]) -> bool:
    """Whether the lexicon has the word or one of its stems, written with a star."""
    return word in lexicon or any(len(word) >= k and word[:k] + "*" in lexicon for k in STEMS)


def word_features(word: str, lexicon: frozenset[str]) -> list[str]:
    """Features of a word: stems and shape for its own place, two for each place beside it."""
    known = is_listed(word, lexicon)
    return [
        "w=" + word, *(word[:k] for k in STEMS), "s=" + word[-3:], f"n={min(len(word), 12)}", f"k={known}",
        "<w=" + word if known else "<", f"<k={known}", ">w=" + word if known else ">", f">k={known}",
    ]


class Chains:
    """Sequences laid end to end, with the order in which their tokens step together."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(self.lengths) else self.lengths
        self.order = np.argsort(-self.lengths, kind="stable")
        self.longest = int(self.lengths.max(initial=0))
        ordered = -self.lengths[self.order]
        self.active = np.searchsorted(ordered, -np.arange(self.longest), side="left")

    def marginals(self, odds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of state 1, forward odds, backward odds) per token."""
        (t00, t01), (t10, t11) = np.exp(trans)
        ahead, back = np.empty_like(odds), np.ones_like(odds)
        lead = self.starts[self.order]
        x = np.ones(0)
        for t in range(self.longest):
            at = lead[:self.active[t]] + t
            e = odds[at]
            x = e if t == 0 else e * (t01 + t11 * x[:len(at)]) / (t00 + t10 * x[:len(at)])
            x = np.clip(x, 1 / _LIMIT, _LIMIT)
            ahead[at] = x
        for t in range(self.longest - 2, -1, -1):
            later = lead[:self.active[t + 1]] + t + 1
            z = odds[later] * back[later]
            back[later - 1] = np.clip((t10 + t11 * z) / (t00 + t01 * z), 1 / _LIMIT, _LIMIT)
        joint = ahead * back
        return joint / (1 + joint), ahead, back


def emission_odds(here: np.ndarray, before: np.ndarray, after: np.ndarray, chains: Chains) -> np.ndarray:
    """Odds per token from its own value, that its left word gives it and its right word's."""
    total = here.copy()
    if len(total) > 1:
        total[1:] += before[:-1]
        total[:-1] += after[1:]
        # a neighbour from another sequence gives nothing
        first = chains.starts[(chains.starts > 0) & (chains.lengths > 0)]
        total[first] -= before[first - 1]
        total[first - 1] -= after[first]
    return np.exp(np.clip(total, -60, 60))


@dataclass
class Crf:
    """Feature weights, transition scores and the logistic that turns marginals into a document score."""

    weights: dict[str, float]
    trans: np.ndarray
    lexicon: frozenset[str]
    calibration: np.ndarray

    MEMORY = 400_000

    def __post_init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.empty((0, 3))

    def _value(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own log odds, to its right and to its left neighbour's."""
        f, w = word_features(word, self.lexicon), self.weights
        a, b = FEATURES_HERE, FEATURES_HERE + FEATURES_BESIDE
        return tuple(sum(w.get(x, 0.0) for x in part) for part in (f[:a], f[a:b], f[b:]))

    def _lookup(self, words: list[list[str]]) -> np.ndarray:
        """(here, before, after) values of every token; words seen are remembered up to a bound."""
        if len(self.known) > self.MEMORY:
            self._forget()
        fresh = set(chain.from_iterable(words)).difference(self.known)
        if fresh:
            plain = self._plain
            stems, weights, lexicon = self._stems, self.weights, self.lexicon
            rows = []
            for w in fresh:
                # most words have no stem, ending or entry of their own: only their length speaks
                if w[:STEMS[0]] in stems or "s=" + w[-3:] in weights or "w=" + w in weights or w in lexicon:
                    rows.append(self._value(w))
                else:
                    rows.append(plain[min(len(w), 12)])
            self.values = np.concatenate([self.values, np.array(rows)])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        return self.values[index]

    @cached_property
    def _stems(self) -> frozenset[str]:
        """The shortest stems under which any weight or lexicon entry stands."""
        named = (x for x in self.weights if not x[:2] in ("w=", "s=", "n=", "k=") and x[:1] not in "<>")
        return frozenset(x[:STEMS[0]] for x in chain(named, (x.rstrip("*") for x in self.lexicon)))

    @cached_property
    def _plain(self) -> list[tuple[float, float, float]]:
        """The value of a word of each length without features of its own."""
        w = self.weights
        rest = w.get("<", 0.0) + w.get("<k=False", 0.0), w.get(">", 0.0) + w.get(">k=False", 0.0)
        return [(w.get(f"n={n}", 0.0) + w.get("k=False", 0.0), *rest) for n in range(13)]

    def tag(self, words: list[list[str]]) -> list[np.ndarray]:
        """Probability of toxic per word of every document."""
        chains = Chains(np.array([len(w) for w in words], np.int64))
        v = self._lookup(words) if chains.longest else np.empty((0, 3))
        p, _, _ = chains.marginals(emission_odds(v[:, 0], v[:, 1], v[:, 2], chains), self.trans)
        return np.split(p, np.cumsum(chains.lengths)[:-1]) if len(words) else []

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Document scores from the marginals of their words."""
        return 1 / (1 + np.exp(-np.clip(document_signals(marginals) @ self.calibration, -50, 50)))


def document_signals(marginals: list[np.ndarray]) -> np.ndarray:
    """Per document: one, log odds of its most toxic word, logs of the expected number of toxic
    words, of all words and of the share of toxic words."""
    top = np.clip(np.array([m.max(initial=0.0) for m in marginals]), 1e-6, 1 - 1e-6)
    count = np.array([m[m > 0.05].sum() for m in marginals])
    size = np.array([len(m) for m in marginals], float)
    share = np.log((count + 0.01) / (size + 1))
    return np.stack([np.ones(len(marginals)), np.log(top / (1 - top)), np.log1p(count), np.log1p(size), share], axis=1)


def split_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def fit_crf(
    texts: list[str], labels: np.ndarray, lexicon: frozenset[str], rounds: int = 60,
    rate: float = 0.3, l2: float = 1e-6, piece: int = 512,
) -> Crf:
    """Maximum likelihood by Adam on tokens labelled from the documents.

    A word of a toxic document that is in the lexicon is labelled toxic, every other
    word clean. For training alone, sequences are cut into pieces of ``piece`` words.
    """
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in split_words(t)], np.int32) for t in texts]
    tokens = np.concatenate([*docs, np.empty(0, np.int32)])
    listed = np.fromiter((is_listed(w, lexicon) for w in vocabulary), bool, len(vocabulary))
    of_toxic = np.repeat(np.asarray(labels, bool), [len(d) for d in docs])
    y = (listed[tokens] & of_toxic).astype(float)
    lengths = np.array([min(piece, len(d) - s) for d in docs for s in range(0, len(d), piece)], np.int64)
    chains = Chains(lengths)
    # as usual for such models, a feature has a weight only if it was seen on a toxic word; those that all words have stay
    toxic_word = np.bincount(tokens, y, len(vocabulary)) > 0
    seen = [w for w, t in zip(vocabulary, toxic_word) if t] + ["x" * n for n in range(13)]
    names: dict[str, int] = {}
    for f in chain.from_iterable(word_features(w, lexicon) for w in seen):
        if f.strip("x"):
            names.setdefault(f, len(names))
    none, width = len(names), FEATURES_HERE + 2 * FEATURES_BESIDE
    features = np.array(
        [names.get(f, none) for w in vocabulary for f in word_features(w, lexicon)], np.int32,
    ).reshape(-1, width)
    weights, trans = np.zeros(none + 1), np.zeros((2, 2))
    a, b = FEATURES_HERE, FEATURES_HERE + FEATURES_BESIDE
    groups = features[:, :a], features[:, a:b], features[:, b:]
    starts = chains.starts[(chains.starts > 0) & (chains.lengths > 0)]
    inner = np.ones(max(0, len(tokens) - 1), bool)
    inner[starts - 1] = False
    m = [np.zeros_like(weights), np.zeros_like(trans)]
    v = [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, rounds + 1 if len(tokens) and y.any() else 1):
        value = [weights[g].sum(1)[tokens] for g in groups]
        odds = emission_odds(*value, chains)
        p, ahead, back = chains.marginals(odds, trans)
        residual = p - y
        left, right = np.zeros_like(residual), np.zeros_like(residual)
        left[:-1] = np.where(inner, residual[1:], 0)
        right[1:] = np.where(inner, residual[:-1], 0)
        grad = l2 * weights * len(tokens)
        for g, r in zip(groups, (residual, left, right)):
            per_word = np.bincount(tokens, r, len(vocabulary))
            grad += np.bincount(g.ravel(), np.repeat(per_word, g.shape[1]), none + 1)
        grad[none] = 0
        z = (odds * back)[1:]
        x = ahead[:-1]
        t = np.exp(trans)
        pair = np.stack([np.full_like(x, t[0, 0]), t[0, 1] * z, t[1, 0] * x, t[1, 1] * x * z])
        pair = (pair / pair.sum(0))[:, inner].sum(1).reshape(2, 2)
        now, then = y[:-1][inner], y[1:][inner]
        met = np.array([[((1 - now) * (1 - then)).sum(), ((1 - now) * then).sum()], [(now * (1 - then)).sum(), (now * then).sum()]])
        for k, (target, g) in enumerate(((weights, grad), (trans, pair - met + 1e-3 * trans))):
            g = g / len(tokens)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            target -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    large = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) >= LEAST_WEIGHT}
    model = Crf(large, trans, lexicon, np.array([0.0, 1.0, 0.0, 0.0, 0.0]))
    signals = [
        document_signals(model.tag([split_words(t) for t in texts[s:s + 256]])) for s in range(0, len(texts), 256)
    ]
    if signals:
        model.calibration = _logistic(np.concatenate(signals), np.asarray(labels, float))
    model._forget()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, l2: float = 0.1) -> np.ndarray:
    """Newton's method for a small ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
