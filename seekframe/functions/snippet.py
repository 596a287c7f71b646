"""Snippets: the best window of a body, with matches in brackets."""

from __future__ import annotations

import regex

from .text import ELLIPSIS, FOLD_FROM, FOLD_TO, TOKEN

WINDOW = 14
_TOKEN = regex.compile(TOKEN)
_MARK = regex.compile(r"\p{Mn}+")
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(token: str) -> str:
    return _MARK.sub("", token.lower()).translate(_FOLD)


def spans(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their places."""
    every = ((fold(m.group()), m.start(), m.end()) for m in _TOKEN.finditer(text))
    return [x for x in every if x[0]]


def tokenize(text: str) -> list[str]:
    return [t for t, _, _ in spans(text)]


def instances(tokens: list[str], phrases: list[list[str]]) -> list[tuple[int, int, int]]:
    """Where phrases stand: (first token, end, phrase), in order."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        at.setdefault(t, []).append(i)
    out = []
    for n, phrase in enumerate(phrases):
        if phrase:
            out += [(i, i + len(phrase), n) for i in at.get(phrase[0], ()) if tokens[i : i + len(phrase)] == phrase]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _worth(found: list[tuple[int, int, int]], start: int, count: int, size: int) -> tuple[int, int]:
    """The worth of the window at ``start``, and where to start so that what it holds is in the middle."""
    inside = [x for x in found if start <= x[0] < start + size]
    if not inside:
        return 0, start
    distinct = len({n for _, _, n in inside})
    first, end = inside[0][0], inside[-1][1]
    middle = first - int((size - (end - first)) / 2)
    return 1000 * distinct + len(inside) - distinct, max(0, min(middle, count - size))


def snippet(text: str | None, phrases: list[list[str]], size: int = WINDOW) -> str:
    text = text or ""
    words = spans(text)
    found = instances([t for t, _, _ in words], phrases)
    count = len(words)
    begin, best = 0, 0
    sentences = [i for i in range(count) if i == 0 or regex.search(r"[.:]\s+$", text[words[i - 1][2] : words[i][1]])]
    for i, _, _ in found:
        worth, at = _worth(found, i, count, size)
        if worth > best:
            begin, best = at, worth
        if count > size:
            sentence = max(s for s in sentences if s <= i)
            worth = _worth(found, sentence, count, size)[0] + (100 if sentence else 120)
            if sentence < i and worth > best:
                begin, best = sentence, worth
    if not count:
        return text
    end = min(begin + size, count)
    merged: list[list[int]] = []
    for a, b, _ in found:
        if begin <= a < end:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], min(b, end))
            else:
                merged.append([a, min(b, end)])
    out, at = [ELLIPSIS] if begin else [], words[begin][1] if begin else 0
    for a, b in merged:
        out += [text[at : words[a][1]], "[", text[words[a][1] : words[b - 1][2]], "]"]
        at = words[b - 1][2]
    out.append(text[at:] if end == count else text[at : words[end - 1][2]] + ELLIPSIS)
    return "".join(out)


def runs(marked: str) -> list[tuple[str, bool]]:
    """Text and whether it is highlighted, from a snippet with brackets."""
    out, at = [], 0
    for m in regex.finditer(r"\[([^\]]*)\]", marked):
        out += [(marked[at : m.start()], False), (m.group(1), True)]
        at = m.end()
    return [x for x in [*out, (marked[at:], False)] if x[0]]
