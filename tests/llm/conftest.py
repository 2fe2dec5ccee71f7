from __future__ import annotations

import random
import string

import pytest


@pytest.fixture
def noise():
    """Random words, seeded."""
    r = random.Random(11)
    return lambda n: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 8))) for _ in range(n))
