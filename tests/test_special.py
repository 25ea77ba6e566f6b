"""Distribution functions against published critical values."""

import pytest

from tesserae.functions import special as S


@pytest.mark.parametrize(("got", "want"), [(S.normal_cdf(1.959963985), 0.975), (S.t_two_sided(2.228138852, 10), 0.05), (S.f_upper(3.105807, 2, 12), (1 + 2 * 3.105807 / 12) ** -6), (S.chi2_upper(5.991464547, 2), 0.05), (S.chi2_upper(18.30703805, 10), 0.05), (S.t_quantile(0.975, 30), 2.042272456), (S.normal_quantile(0.9), 1.281551566), (S.f_upper(4.964602744, 1, 10), 0.05)])
def test_critical_values(got, want):
    assert got == pytest.approx(want, abs=2e-4)
