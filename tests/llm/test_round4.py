"""Inputs on which training-data operators failed their limits in the third round."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cratewise.llm import quality


def test_statistics_hold_a_small_piece_of_the_texts():
    """pipeline: the temporaries of a batch stay under 32 MB; with pieces of a megabyte they were 81 MB."""
    rng = np.random.default_rng(4)
    words = np.array(["drop", "bass", "a", "Kick.", "mix", "the", "12", "loop,", "wave", "deep"])
    texts = pa.array([" ".join(rng.choice(words, 400)) for _ in range(2500)])
    single = np.concatenate([quality.statistics(texts.slice(i, 1)) for i in range(0, 2500, 250)])
    tracemalloc.start()
    whole = quality.statistics(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(whole[::250], single)
    assert peak < 32e6, peak
