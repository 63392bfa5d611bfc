import pytest

from gridmoments import schedules as S

BLOCKS_16 = [2, 4, 5, 6, 8, 10, 12, 14, 15, 16]
BLOCKS_124 = [20, 30, 40, 41, 52, 60, 62, 80, 82, 90, 100, 104, 120, 123, 124]


def test_extents_and_ranges():
    assert S.truncated_block_extent(124, 21) == (105, 19)
    assert S.subsample_closed_range(20, 60, 5) == [20, 30, 40, 50, 60]
    assert S.subsample_closed_range(60, 120, 5) == [60, 75, 90, 105, 120]
    assert S.subsample_closed_range(5, 5, 10) == [5]
    assert S.subsample_closed_range(4, 9, 1) == [6]
    assert S.subsample_closed_range(3, 2, 4) == [] == S.subsample_closed_range(1, 5, 0)
    assert [S.budget_split(b) for b in (10, 9, 1)] == [(5, 5), (4, 5), (1, 0)]
    assert S.crop((4, 4, 4), (2, 4, 0)) == (2, 4, 0)
    with pytest.raises(ValueError):
        S.crop((4, 4, 4), (5, 4, 4))
    with pytest.raises(ValueError):
        S.truncated_block_extent(4, 0)


def test_block_factors():
    assert S.block_factors(124, 124, 50.0, 1000.0) == BLOCKS_124
    assert S.block_factors(16, 16, 50.0, 100.0) == BLOCKS_16
    assert len(S.block_factors(124, 124, 48.78, 200.0)) == 36
    assert S.block_factors(8, 8, 10.0, 1000.0) == [8]
    assert S.block_factors(8, 8, 10.0, 30.0, None) == [3, 4, 5, 6, 7, 8]
    assert S.vertical_factors(8, 50.0, 400.0, 10) == list(range(1, 9))
    assert S.vertical_factors(8, 50.0, 400.0, 1) == [2, 4, 6, 8]
    assert S.effective_fz_max(7, 10.0, 400.0) == 7
    assert S.effective_fz_max(7, 500.0, 400.0) == 0


def test_hybrid_equals_block_for_budgets_of_two_and_more():
    for budget in (2, 5, 10):
        assert S.hybrid_triples(124, 124, 20, 50.0, 1000.0, 20.0, 400.0, budget)[1] == []
    assert S.hybrid_triples(8, 8, 7, 100.0, 200.0, 50.0, 350.0, 1)[1] == [(5, 5, 5)]
    extra = S.extra_windows(124, 124, 50.0, 1000.0, {20, 40, 60, 80, 100, 120, 124})
    assert extra and min(extra) >= 62 and not set(extra) & {80, 100, 120, 124}


def test_ladders_and_schemes():
    rows = S.seed_schedule(124, 6000 / 123, (1, 31), 1000.0)
    assert {31, 62, 124} <= {f for f, _, _ in rows} and rows == sorted(rows)
    with pytest.raises(ValueError):
        S.seed_schedule(124, 50.0, (2,), 100.0)
    with pytest.raises(ValueError):
        S.seed_schedule(124, 50.0, (3, 3), 100.0)
    assert S.seed_ladder(12, 3) == [3, 6, 12]
    assert {(1, 1, 1), (2, 2, 2), (3, 3, 3)} <= set(S.divisor_triples(6, 6, 6, 50.0, 100.0, 50.0, 400.0))
    assert S.divisor_triples(4, 2, 1, 1.0, 0.0, 1.0, 1.0, square=False)[-1] == (4, 2, 1)
    assert S.z_scheme([10.0] * 127, 400.0) == [(1, 10), (2, 20), (4, 40), (8, 80), (16, 160), (32, 320)]
    assert S.z_scheme([500.0] * 50, 400.0) == [(1, 500)]


def test_windows():
    assert [a + 1 for a in S.anchors(10, 3, 3)] == [1, 4, 8]
    assert [a + 1 for a in S.anchors(124, 70, 3)] == [1, 28, 55]
    assert S.anchors(16, 16, 2) == S.anchors(6, 6, 3) == [0]
    assert [S.uniform_stride(*x) for x in ((124, 70, 2), (124, 70, 3), (125, 70, 3))] == [54, 27, 27]
    assert [S.window_count(*x) for x in ((5, 6, 1), (7, 3, 2))] == [0, 3]
    with pytest.raises(ValueError):
        S.anchors(3, 4, 1)


def test_thickness_and_edges():
    assert S.span_dz([1, 2, 3, 4, 5, 6], 2) == [3, 7, 11]
    assert S.span_dz([1, 2, 3, 4, 5, 6, 99], 3) == [6, 15]
    assert S.centers_to_edges([]) == []
    assert S.centers_to_edges([2.0]) == [1.5, 2.5]
    assert S.centers_to_edges([1.0, 2.0, 4.0]) == [0.5, 1.5, 3.0, 5.0]
    assert S.horizontal_levels(8, 8, 100.0, (1,), 200.0) == [(2, 2), (4, 4), (8, 8)]
