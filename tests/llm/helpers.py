"""Small texts of invented words."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri", "su", "ta") for b in ("ran", "sel", "tin", "vor", "wex", "zul", "gam", "hod")]


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(words: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join("x" + w if rng.random() < share else w for w in words.split(" "))
