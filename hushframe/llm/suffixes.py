"""Cutting texts into pieces of suffixes that meet, and sorting them in two stages."""

from __future__ import annotations

import numpy as np

#: Bytes of a gram. A string's anchor is the gram of the smallest hash in it.
GRAM = 32
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for k in range(8):
        part = data[k : k + (n - k + 7) // 8 * 8] if k < n else data[:0]
        words[k::8] = np.frombuffer(part.tobytes(), "<u8") if len(part) else 0
    m = len(data) - GRAM + 1
    out = np.zeros(m, np.uint64)
    for k, seed in enumerate(_SEEDS):
        part = words[8 * k : 8 * k + m] * seed
        part ^= part >> np.uint64(29 + k)
        out += part
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(data: np.ndarray, bounds: np.ndarray, length: int):
    """Runs of strings of ``length`` bytes with one smallest gram hash, in documents that ``bounds`` part.

    Returns (start, number of strings, hash, offset of the first such gram in the first string) of each run.
    """
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none
    hashes = gram_hashes(data)
    least = sliding_min(hashes, width)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = doc[: len(least)] == doc[length - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    # A run ends where another begins or a string would leave its document.
    cut = np.append(np.flatnonzero(new | ~inside), len(least))
    size = cut[np.searchsorted(cut, start, "right")] - start
    value = least[start]
    offset = np.full(len(start), width - 1)
    old = np.flatnonzero(hashes[start + width - 1] != value)
    for i in range(0, len(old), 16384):
        at = start[old[i : i + 16384]]
        offset[old[i : i + 16384]] = (hashes[at[:, None] + np.arange(width)[None]] == least[at][:, None]).argmax(axis=1)
    # The gram that has just come in may also stand earlier in the string.
    return start, size, value, offset


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """All places of ``text`` in the order of their suffixes, right in their first ``length`` characters.

    ``text`` holds characters from 1 to 256 and ends in 0; a 0 ends a suffix. Only suffixes that are smaller than their
    successors are sorted directly. One scan over the buckets of first characters, from the smallest on, then places each
    other suffix when the suffix behind it is reached, as it is larger than that one.
    """
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    ends = np.flatnonzero(differs)
    run_end = ends[np.searchsorted(ends, np.arange(n))]
    after = np.append(text[1:], 0)
    smaller = (text[run_end] < after[run_end]) | (text == 0)
    direct = np.flatnonzero(smaller & (text != 0))
    direct = direct[_sorted(text, direct, length)]
    first = text[direct]
    cut = np.searchsorted(first, np.arange(258))
    placed: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero(text == 0)
        else:
            # Within a bucket a place can have its predecessor's character: placed round by round.
            front = np.concatenate(placed[c]) if placed[c] else np.zeros(0, np.int64)
            larger = [front]
            while len(front):
                front = front[front > 0] - 1
                front = front[text[front] == c]
                larger.append(front)
            bucket = np.concatenate([*larger, direct[cut[c] : cut[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        said = text[before]
        later = said > c
        before, said = before[later], said[later]
        if not len(said):
            continue
        by = np.argsort(said, kind="stable")
        before, said = before[by], said[by]
        heads = np.flatnonzero(np.append(True, said[1:] != said[:-1]))
        for a, b in zip(heads, [*heads[1:], len(said)], strict=True):
            placed[int(said[a])].append(before[a:b])
    return np.concatenate(order)


#: Characters of 9 bits in a word that is compared at once.
_WORD = 7


def _words(text: np.ndarray, length: int) -> np.ndarray:
    wide = np.concatenate([text, np.zeros(length + _WORD, text.dtype)]).astype(np.uint64)
    out = np.zeros(len(text) + length, np.uint64)
    for k in range(_WORD):
        out = out << np.uint64(9) | wide[k : k + len(out)]
    return out


def _sorted(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The order of some suffixes by their first ``length`` characters: word by word, and on only where words are equal."""
    words = _words(text, length)
    order = np.argsort(words[places], kind="stable")
    group = np.cumsum(np.append(True, np.diff(words[places[order]]) != 0)) if len(order) else order
    for depth in range(_WORD, length, _WORD):
        same = np.append(False, group[1:] == group[:-1])
        open_ = np.flatnonzero(same | np.append(same[1:], False))
        if not len(open_):
            break
        key = words[places[order[open_]] + depth]
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_[by]]
        key, old = key[by], group[open_]
        fresh = np.ones(len(group), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[open_[1:]] |= (open_[1:] == open_[:-1] + 1) & (old[1:] == old[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(fresh)
    return order


def repeated(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of each string of ``length`` bytes in the pieces that also starts earlier in one of them.

    A piece begins at ``start`` of its document and stands for the strings that lie in it; no string stands in two pieces.
    ``length`` is at least 7.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(pieces), np.uint8)
    text[: len(raw)] = raw
    text += np.uint16(1)
    text[begin + sizes] = 0
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    inside = np.arange(len(text)) - begin[owner]
    whole = inside + length <= sizes[owner]
    order = suffix_order(text, length)
    order = order[whole[order]]
    if len(order) < 2:
        none = np.zeros(0, np.int64)
        return none, none
    # Common prefixes of neighbours, as far as they matter: at least `length` characters or fewer.
    words = _words(text, length)
    alike = np.arange(1, len(order))
    for depth in [*range(0, length - _WORD, _WORD), max(0, length - _WORD)]:
        alike = alike[words[order[alike] + depth] == words[order[alike - 1] + depth]]
    joins = np.zeros(len(order), bool)
    joins[alike] = True
    group = np.cumsum(~joins)
    member = np.flatnonzero(joins | np.append(joins[1:], False))
    at, group = order[member], group[member]
    where = doc[owner[at]], start[owner[at]] + inside[at]
    by = np.lexsort((where[1], where[0], group))
    later = by[1:][group[by[1:]] == group[by[:-1]]]
    return where[0][later], where[1][later]
