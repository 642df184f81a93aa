"""Sets that link share a key, whatever their tokens' frequencies; bounds never turn down a link."""

import numpy as np
import pytest

from cadenza.llm.ngram_join import parity, signatures


@pytest.mark.parametrize("scale", [1, 20, 1000])
def test_linked_sets_share_a_key(scale):
    rng = np.random.default_rng(scale)
    sets = []
    for _ in range(6):
        base = rng.integers(-(2**62), 2**62, rng.integers(3, 120))
        for _ in range(12):
            kept = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, rng.integers(0, 1 + len(base) // 8))])))
    sets = [s for s in sets if len(s)]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    df = dict(zip(tokens.tolist(), (counts * np.where(counts > 1, scale, 1)).tolist(), strict=True))
    found = []
    for s in sets:
        order = sorted((df[t], t) for t in s.tolist() if df[t] > 1)
        d, h = np.array([x for x, _ in order], dtype=np.int64), np.array([x for _, x in order], dtype=np.int64)
        found.append((len(s), set(signatures(d, h, len(s)).tolist()), parity(h), len(h)))
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links += 1
                (n, x, p, c), (m, y, q, e) = found[i], found[j]
                bits = sum(int(v & (2**64 - 1)).bit_count() for v in (p ^ q).tolist())
                assert x & y and 9 * min(c, e) >= 4 * (n + m) and n + m - c - e + bits <= (n + m) // 9
    assert links > 50
