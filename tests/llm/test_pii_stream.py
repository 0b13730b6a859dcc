"""Decoding as a stream gives what the whole lattice gives, in memory that doesn't grow with an island."""

import random
import tracemalloc

from quillon.llm import pii
from quillon.llm.pii import PiiOptions, _fitted, islands, lattice


def texts():
    r = random.Random(11)
    pieces = ["12", "4111 1111 1111 1111", "(415) 555-0100", "jane (at) site (dot) org", "10.0.0.1", "@", "+49 30 123456", "4111.1111.1111.1111", "0", "a1", "] [at] b.com", "--", "555-0199", "20240102"]
    for _ in range(120):
        yield "".join(r.choice(pieces) + r.choice((" ", " ", "", ", ", "  ")) for _ in range(r.randint(1, 60)))
    yield "12 " * 700 + "call (415) 555-0100 " + "7 " * 900 + "4111.1111.1111.1111 " + "3-" * 800


def test_batches_change_nothing(monkeypatch):
    options = PiiOptions()
    model = _fitted(options)
    for text in texts():
        want = [model.decode(lattice(text, *island, options.longest)) for island in islands(text)]
        for batch in (1, 7, 50, 2_000):
            monkeypatch.setattr(pii, "BATCH", batch)
            assert [model.decode_text(text, *island, options.longest) for island in islands(text)] == want


def peak(n):
    text, options = "12 " * n, PiiOptions()
    pii._features.cache_clear()
    tracemalloc.start()
    pii.all_spans(text, _fitted(options), options.longest)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return size


def test_memory_does_not_grow_with_digits():
    _fitted(PiiOptions())
    small, large = peak(10_000), peak(60_000)
    assert large < small + 20 * 2**20 and large < 80 * 2**20
