"""The exchange step against the likelihood counted anew for every move."""

from __future__ import annotations

import random

import numpy as np

from axistab.llm import brown


def likelihood(stream, of, width):
    """Of the class bigrams: what depends on the classes in the log-likelihood of a class-based bigram model."""
    n = np.zeros((width, width))
    for a, b in zip(stream, stream[1:], strict=False):
        n[of[a], of[b]] += 1
    log = lambda x: (x * np.log(np.where(x > 0, x, 1))).sum()
    return log(n) - log(n.sum(axis=1)) - log(n.sum(axis=0)), n


def corpus(rng, words, length):
    """Words of four kinds that follow each other in turn more often than not, none after itself; 0 ends a text."""
    out = [0]
    while len(out) < length:
        kind = (out[-1] + 1) % 4 if rng.random() < 0.7 else rng.randrange(4)
        word = 0 if rng.random() < 0.05 else 1 + kind + 4 * int(rng.random() ** 2 * (words // 4))
        if word != out[-1]:
            out.append(word)
    return [*out, 0]


def test_exchange_takes_the_best_class_by_likelihood():
    rng, classes, words = random.Random(4), 5, 40
    stream = corpus(rng, words, 4000)
    width = classes + 2
    of = {w: rng.randrange(classes) for w in range(1, words + 2)} | {0: classes + 1}
    start, matrix = likelihood(stream, of, width)
    known = sorted(set(stream) - {0})
    right, left = np.zeros((len(known), width)), np.zeros((len(known), width))
    for a, b in zip(stream, stream[1:], strict=False):
        if a:
            right[known.index(a), of[b]] += 1
        if b:
            left[known.index(b), of[a]] += 1
    found = brown.exchange(right, left, np.array([of[w] for w in known], np.uint8), matrix, classes)
    moved = 0
    for w, c in zip(known, found.tolist(), strict=True):
        each = [likelihood(stream, of | {w: k}, width)[0] for k in range(classes)]
        assert each[c] >= max(each) - 1e-6, (w, c, each)
        moved += c != of[w]
    assert moved > 10
    # One word at a time, each move raises the likelihood of all of them.
    total = start
    for w, c in zip(known, found.tolist(), strict=True):
        alone = likelihood(stream, of | {w: c}, width)[0]
        assert alone >= start - 1e-6
        total = max(total, alone)
    assert total > start


class Held:
    """What a task sees of a broadcast."""

    def __init__(self, value):
        self.value = value


def test_rare_words_take_the_best_class_by_likelihood():
    """The answer to one block's question: every word that is not frequent, others staying where they are."""
    import pyarrow as pa

    rng, classes, words = random.Random(9), 5, 40
    stream = corpus(rng, words, 3000)
    width = classes + 2
    names = {w: b"" if w == 0 else f"w{w}".encode() for w in range(words + 2)}
    known = sorted(set(stream))
    frequent = [w for w in known if w <= 20]
    own = np.array([classes + 1 if w == 0 else rng.randrange(classes) for w in frequent], np.uint8)
    of = {w: int(own[frequent.index(w)]) if w in frequent else classes for w in known}
    _, matrix = likelihood(stream, of, width)
    index, now = Held({names[w]: i for i, w in enumerate(frequent)}), Held(own)
    count, contexts = {w: stream.count(w) for w in known}, {}
    for a, b in zip(stream, stream[1:], strict=False):
        if a not in frequent:
            contexts[known.index(a), of[b]] = contexts.get((known.index(a), of[b]), 0) + 1
        if b not in frequent:
            contexts[known.index(b), width + of[a]] = contexts.get((known.index(b), width + of[a]), 0) + 1
    keys = sorted(contexts)
    row = [
        0, 7, brown._pack(b" ".join(names[w] for w in known)), brown._pack(np.array([count[w] for w in known], np.int64)),
        brown._pack(np.array([k for k, _ in keys], np.int32)), brown._pack(np.array([c for _, c in keys], np.uint8)),
        brown._pack(np.array([contexts[k] for k in keys], np.int64)),
    ]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    asked = pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "block", "words", "counts", "word", "code", "n"])
    out = brown._answered(index, now, matrix, classes)(asked).to_pylist()
    kind = brown._unpack(out[0]["kinds"], np.uint8)
    assert brown._unpack(out[0]["counts"], np.int64).tolist() == [count[w] for w in known]
    assert [kind[known.index(w)] for w in frequent] == own.tolist()
    for w in known:
        if w in frequent:
            continue
        # Joining a class from the class of all words not placed, which loses nothing by it in this count.
        c = int(kind[known.index(w)])
        r, l = np.zeros(width), np.zeros(width)  # noqa: E741
        for (k, x), n in contexts.items():
            if known[k] == w:
                (r if x < width else l)[x % width] += n
        each = []
        for k in range(classes):
            n = matrix.copy()
            n[k] += r
            n[:, k] += l
            log = lambda x: (x * np.log(np.where(x > 0, x, 1))).sum()
            each.append(log(n) - log(matrix.sum(axis=1) + r.sum() * (np.arange(width) == k)) - log(matrix.sum(axis=0) + l.sum() * (np.arange(width) == k)))
        assert each[c] >= max(each) - 1e-6, (w, c, each)
