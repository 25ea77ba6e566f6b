"""The subsample of an isolation tree at any number of rows."""

from tesserae.operators import models


def test_share_of_the_subsample_follows_the_rows():
    for n in (10, 10**6, 3 * 10**8, 10**9, 10**12):
        share = (models.sample_limit(n, 256) + 2**63 + 1) / 2**64
        assert abs(share / min(1.0, 512 / n) - 1) < 1e-6
