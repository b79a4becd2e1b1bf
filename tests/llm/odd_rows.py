"""Odd documents that every operator must take."""

import random

WORDS = "ash birch cedar dogwood elm fir ginkgo hazel iris juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.5 else "") + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


ODD = [
    (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "Two words"), (5, prose(5, 80)), (6, prose(5, 80)), (7, prose(7, 3000)), (8, prose(5, 79) + " changed"),
    (9, "é ünï \U0001f600 " * 30), (10, prose(7, 3000)), (11, prose(11, 120)), (12, "x" * 70000),
]


def rich(seed, n):
    """Prose of many different words."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("an", "be", "co", "di", "er", "fu", "go", "hi", "in", "lo", "mu", "no", "on", "re", "th")) for _ in range(rng.randrange(1, 4))) for _ in range(n))
