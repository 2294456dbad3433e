"""Pre-token boundaries by a scan over codepoint classes, without regular expressions.

The boundaries are those of the pattern that splits text for the rank files: English
contractions, then runs of letters, numbers or other signs with one optional leading
space, then white space, of which the last character before a word stands alone.

Each codepoint has a class, each class is a function from automaton states to states,
and functions compose associatively. All functions that can arise form a small monoid,
so a prefix of any length is one byte, and prefixes are found by table lookups: first
inside blocks (all blocks of a batch at once), then over the blocks by doubling.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import tiktoken

SEP, SPACE, WHITE, APOSTROPHE, OTHER, NUMBER, LETTER, STMD, R_V, E, L = range(11)
CLASSES = 11
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_SPACE, AT_WHITE, QUOTE, QUOTE_RV, QUOTE_L, DONE = range(10)
STATES = 10
LETTERS = (LETTER, STMD, R_V, E, L)
BLOCK = 64
#: Codepoints whose classes are asked for at a time.
SPAN = 1 << 13


def _next_state(state: int, kind: int) -> int:
    if kind == SEP:
        return START
    if kind in (SPACE, WHITE):
        return AT_SPACE if kind == SPACE else AT_WHITE
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == OTHER:
        return IN_OTHERS
    if kind == APOSTROPHE:
        return IN_OTHERS if state in (AT_SPACE, IN_OTHERS, QUOTE) else QUOTE
    if state == QUOTE:
        return {STMD: DONE, R_V: QUOTE_RV, L: QUOTE_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((QUOTE_RV, E), (QUOTE_L, L)):
        return DONE
    return IN_LETTERS


#: What the boundary before a codepoint depends on beyond the state before it.
NO, YES, BEFORE_WORD, UNLESS_E, UNLESS_L = range(5)


def _boundary(state: int, kind: int) -> int:
    if kind == SEP:
        return NO
    if state == START:
        return YES
    if kind in (SPACE, WHITE):
        return BEFORE_WORD if state in (AT_SPACE, AT_WHITE) else YES
    if state == AT_SPACE:
        return NO
    if kind == NUMBER:
        return NO if state == IN_NUMBERS else YES
    if kind in (OTHER, APOSTROPHE):
        return NO if state in (IN_OTHERS, QUOTE) else YES
    if state == QUOTE:
        return {STMD: NO, R_V: UNLESS_E, L: UNLESS_L}.get(kind, YES)
    return NO if state in (IN_LETTERS, QUOTE_RV, QUOTE_L) else YES


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Products of the monoid's elements with classes and with each other, what an
    element does to a state, and the boundary rules. Element 0 is the identity."""
    classes = [tuple(_next_state(s, k) for s in range(STATES)) for k in range(CLASSES)]
    elements = [tuple(range(STATES))]
    known = {elements[0]: 0}
    for f in elements:
        for g in classes:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(elements)
                elements.append(h)
    by_class = np.array(
        [[known[tuple(g[s] for s in f)] for g in classes] for f in elements], np.uint8
    )
    by_element = np.array(
        [[known[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8
    )
    rules = [[_boundary(s, k) for k in range(CLASSES)] for s in range(STATES)]
    return by_class, by_element, np.array(elements, np.uint8), np.array(rules, np.uint8)


@cache
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, letters and numbers as the tokenizer library has them."""
    table = np.full(0x110000, OTHER, np.uint8)
    singles = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        for lo in range(0, 0x110000, SPAN):
            some = "".join(chr(i) for i in range(lo, lo + SPAN) if not 0xD800 <= i < 0xE000)
            found = bytes(probe.encode_ordinary(some)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for kind, signs in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (R_V, "rv"), (E, "e"), (L, "l")):
        table[[ord(c) for c in signs]] = kind
    return table


def _states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before every position."""
    by_class, by_element, action, _ = _tables()
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = by_class.ravel()
    prefix = np.empty((BLOCK + 1, rows), np.uint8)
    prefix[0] = 0
    for j in range(BLOCK):
        prefix[j + 1] = flat[prefix[j].astype(np.intp) * CLASSES + columns[j]]
    totals, step = prefix[BLOCK].copy(), 1
    while step < rows:
        totals[step:] = by_element[totals[:-step], totals[step:]]
        step *= 2
    entering = np.zeros(rows, np.intp)
    entering[1:] = action[totals[:-1], START]
    before = action.ravel()[prefix[:BLOCK].astype(np.intp) * STATES + entering]
    return np.ascontiguousarray(before.T).ravel()[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of a batch of texts: the joined text, the start and end of each pre-token
    in it, and the number of pre-tokens in front of each text (one more than texts)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = codepoint_classes()[codes]
    seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds[seps] = SEP
    rule = _tables()[3].ravel()[_states(kinds).astype(np.intp) * CLASSES + kinds]
    following = np.append(kinds[1:], np.uint8(SEP))
    first = rule == YES
    for need, wrong in ((UNLESS_E, (E,)), (UNLESS_L, (L,)), (BEFORE_WORD, (SEP, SPACE, WHITE))):
        at = np.flatnonzero(rule == need)
        first[at] = ~np.isin(following[at], wrong)
    starts = np.flatnonzero(first)
    before = np.concatenate(([0], np.searchsorted(starts, seps)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    full = np.flatnonzero(np.diff(before))
    ends[before[full + 1] - 1] = seps[full]
    return joined, starts, ends, before


def pieces(texts: list[str]) -> tuple[list[str], list[int]]:
    """Pre-tokens of a batch of texts, and the number in front of each text."""
    joined, starts, ends, before = boundaries(texts)
    cut = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return cut, before.tolist()
