from __future__ import annotations

import random

import numpy as np

from granary.llm import suffix_array as sa


def test_bytes_are_induced_once(monkeypatch):
    passes, own = [], sa.induce
    monkeypatch.setattr(sa, "induce", lambda t, *rest: passes.append(t.dtype == np.uint8) or own(t, *rest))
    rng = random.Random(2)
    for k in range(400):
        some = rng.choice([b"ab", b"\x00\xff", b"\x00\x01\xfe\xff", b"aaab", bytes(range(256))])
        text = b"".join(bytes([rng.choice(some)]) * rng.randrange(1, 11 if k % 3 else 2) for _ in range(rng.randrange(1, 40)))
        text = text[:9] * 7 if k % 5 == 0 else text
        passes.clear()
        assert sa.suffix_array(np.frombuffer(text, np.uint8), 256).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        assert sum(passes) == 1
