"""Plain versions of the operators, one text at a time, to hold results against."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def components(texts):
    """Smallest id reachable by links, for each id of the dict."""
    sets = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    of = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in of[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for s in sets[i]:
            of[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in texts}


def without_repeats(texts):
    """Texts by id after line dedup, with the number of removed lines."""
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        for a in range(len(at) - 2):
            key = tuple(lines[k] for k in at[a : a + 3])
            if key in seen:
                gone[i] |= set(range(at[a], at[a + 2] + 1))
            seen.add(key)
    return {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in texts.items()}


def contained(texts, items):
    """(id, item) pairs with three quarters of the item's shingles in the text."""
    wanted = {i: shingles(t) for i, t in items.items()}
    found = set()
    for i, text in texts.items():
        own = shingles(text)
        found |= {(i, k) for k, s in wanted.items() if s and 4 * len(s & own) >= 3 * len(s)}
    return found
