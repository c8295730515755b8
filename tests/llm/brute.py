"""Plain versions of the operators on near duplicates."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def line_set(line, k=8):
    line = line.strip(" \t\r").translate(LOWER)
    return line, frozenset(line[i : i + k] for i in range(len(line) - k + 1))


def groups(sets, percent):
    """Smallest name reachable, over links of the given similarity; names in order."""
    by_item, root = {}, {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for n, own in sorted(sets.items()):
        common = {}
        for item in own:
            for m in by_item.get(item, ()):
                common[m] = common.get(m, 0) + 1
            by_item.setdefault(item, []).append(n)
        for m, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[m]) - c):
                a, b = find(n), find(m)
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in sets}
