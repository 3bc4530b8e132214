import numpy as np

from waymark.functions import kernels


def test_simplifying_keeps_the_first_of_equally_far_points():
    for turn in np.linspace(0.1, 3.0, 60):
        xy = np.array([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 0.0)]) @ np.array([(np.cos(turn), np.sin(turn)), (-np.sin(turn), np.cos(turn))])
        assert kernels.simplify_xy(xy + 139.3, 0.9).tolist() == [0, 1, 3]
        assert kernels.simplify_xy(xy + 139.3, 1.0).tolist() == [0, 3]
