"""Property tests of the static tables and the chunk rule behind the
operators (no Spark needed)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st


@given(st.lists(st.integers(min_value=0, max_value=50), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=8), st.integers(min_value=1, max_value=120))
@settings(max_examples=200, deadline=None)
def test_next_start_rule_matches_the_writer(sizes, max_count, max_bytes):
    from shardforge.operators.shards import _next_starts
    nxt = _next_starts(sizes, max_count, max_bytes)
    for r in range(len(sizes)):
        # the writer starting a shard at r: add records until the check fires
        cnt, sz, j = 0, 0, r
        while j < len(sizes) and not (cnt >= max_count or sz >= max_bytes):
            cnt, sz, j = cnt + 1, sz + sizes[j], j + 1
        assert min(nxt[r], len(sizes)) == j


@given(st.integers(min_value=2, max_value=32), st.integers(min_value=1, max_value=32))
def test_bicubic_rows_sum_to_one(n_in, n_out):
    from shardforge.operators.grids import bicubic_weights
    for taps in bicubic_weights(n_in, n_out):
        assert abs(sum(w for _, w in taps) - 1.0) < 1e-12
        assert all(0 <= i < n_in for i, _ in taps)


@given(st.lists(st.integers(min_value=1, max_value=4), min_size=1, max_size=4), st.randoms())
def test_permutation_then_inverse_is_identity(shape, rnd):
    from shardforge.functions.arrays import permutation_index
    order = list(range(len(shape)))
    rnd.shuffle(order)
    fwd = permutation_index(shape, order)
    permuted_shape = [shape[o] for o in order]
    inv = permutation_index(permuted_shape, list(np.argsort(order)))
    assert [fwd[i] for i in inv] == list(range(int(np.prod(shape))))


@given(st.integers(min_value=1, max_value=4), st.sampled_from([1, 2, 4]), st.integers(min_value=1, max_value=4))
def test_patch_index_is_a_permutation(c, p, tiles):
    from shardforge.operators.grids import patch_index
    h = w = p * tiles
    assert sorted(patch_index((c, h, w), p)) == list(range(c * h * w))


@given(st.integers(min_value=0, max_value=10**9), st.integers(min_value=0, max_value=300))
def test_python_normal_twins_agree(key, j):
    from shardforge.functions.rng import py_normal
    from shardforge.operators.trajectory import np_hashed_normals
    a = py_normal(0, "noise", key, j)
    b = np_hashed_normals(0, "noise", np.array([key]), np.array([j]))[0, 0]
    assert abs(a - b) <= 1e-14 * max(1.0, abs(a))     # two libraries' cosines may differ in the last place
