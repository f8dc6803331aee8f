"""Plain Python definitions that the Spark operators are checked against."""

import re


def strip(text):
    return re.sub("[^a-z0-9 ]", "", text.lower())


def grams(text):
    text = strip(text)
    if len(text) < 2:
        return {"#" + text}
    return {text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)}


def dice(a, b):
    a, b = grams(a), grams(b)
    return 2.0 * len(a & b) / (len(a) + len(b))


def full_dice(a, b):
    (l1, f1), (l2, f2) = a.split(",")[:2], b.split(",")[:2]
    return 0.3 * dice(f1, f2) + 0.7 * dice(l1, l2)


def jaro_winkler(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    matched_a = []
    for i, char in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(b))):
            if not used[j] and b[j] == char:
                used[j] = True
                matched_a.append(char)
                break
    matched_b = [c for c, hit in zip(b, used) if hit]
    m = len(matched_a)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def names(n, seed=7):
    """Random names from few syllables, so that similar and equal parts are common."""
    import random

    draw = random.Random(seed)
    syllables = ["an", "ber", "co", "de", "el", "fa", "gi", "ha"]

    def word():
        return "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))

    return [f"{word()},{word()}" for _ in range(n)]
