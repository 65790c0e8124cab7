"""The corpus order of all suffixes by prefix-free parsing, in memory: what the operator's spans are held against."""

import numpy as np

from clonelens.llm.repeats import GRAM, _mix, _powers


def corpus_suffix_array(texts: list[bytes]) -> list[tuple[int, int]]:
    """Corpus order of all suffixes as (text, place), by prefix-free parsing, for texts that fit in memory.

    Phrases are cut at triggers of the rolling hash and overlap by GRAM bytes, so no phrase suffix longer than GRAM
    is a prefix of another. The suffix array of the dictionary orders suffixes by phrase; ties go by the order of
    what follows in the parse, from the suffix array of the parse. Texts end in one separator below all bytes.
    """
    phrases: list[list[tuple[int, bytes]]] = []
    for text in texts:
        data = np.frombuffer(text, dtype=np.uint8)
        starts = [0]
        if len(data) > GRAM:
            t = _powers()
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(t.letters[data] * t.powers[: len(data)])])
                rolling = _mix((sums[GRAM:] - sums[:-GRAM]) * t.inverses[: len(data) - GRAM + 1])
            starts += [int(i) for i in np.flatnonzero(rolling % np.uint64(32) == 0) if i]
        ends = [s + GRAM for s in starts[1:]] + [len(text)]
        phrases.append([(s, text[s:e]) for s, e in zip(starts, ends)])
    rank = {p: i for i, p in enumerate(sorted({p for own in phrases for _, p in own}))}
    # suffix array of the parse by doubling; each text's parse ends below everything
    flat = [rank[p] + 1 for own in phrases for p in [x for _, x in own]]
    owner = np.repeat(np.arange(len(phrases)), [len(own) for own in phrases])
    order = np.array(flat, dtype=np.int64)
    step = 1
    while len(order) and step < len(order):
        ahead = np.zeros(len(order), dtype=np.int64)
        ahead[:-step] = np.where(owner[step:] == owner[:-step], order[step:], 0)
        _, fresh = np.unique(np.column_stack([order, ahead]), axis=0, return_inverse=True)
        fresh = fresh.ravel() + 1
        if (fresh == order).all():
            break
        order, step = fresh, step * 2
    after = np.zeros(len(order), dtype=np.int64)
    after[:-1] = np.where(owner[1:] == owner[:-1], order[1:], 0) if len(order) > 1 else after[:-1]
    rows, k = [], 0
    for t, own in enumerate(phrases):
        for i, (start, phrase) in enumerate(own):
            end = len(phrase) - (GRAM if i < len(own) - 1 else 0)
            rows += [(phrase[o:], int(after[k]), t, start + o) for o in range(end)]
            k += 1
    rows.sort()
    return [(t, place) for _, _, t, place in rows]
