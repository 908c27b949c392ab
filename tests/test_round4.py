"""Work that grew too fast in the third round."""

import numpy as np
import pyarrow as pa

from cratewise.operators import lsh
from cratewise.operators.grouped import ASKED, STORED


def test_a_group_meets_pairs_of_several_bands_once():
    """a group of asked vectors keeps k different keys, though bands find a pair more than once."""
    units = np.random.default_rng(3).normal(size=(40, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    plan = lsh.Plan(4, 3, 16, 1)
    group = lsh._key_group(plan, 6)(5)
    group.take(ASKED, 0, pa.record_batch({"vid": [str(i) for i in range(40)], "unit": list(units)}))
    own = plan.keys(6).of(units)[0] + (np.arange(3) << 40)
    for cell in np.unique(own):
        at = np.nonzero((own == cell).any(axis=1))[0]
        group.take(STORED, int(cell), pa.record_batch({"unit": list(units[at]), "keys": [[int(i)] for i in at]}))
    group.compact()
    q, sim, key = group.hits[0]
    want = np.argsort(-(units @ units.T), axis=1)[:, :5]
    assert np.array_equal(q, np.repeat(np.arange(40), 5)) and np.array_equal(key.reshape(40, 5), want)
