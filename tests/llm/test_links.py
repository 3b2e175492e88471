"""Connectives and clause depth of the reading levels."""

from __future__ import annotations

import numpy as np
import pytest

from quirework.llm import levels


@pytest.mark.parametrize(
    ("plain", "deep"),
    [
        ("Le juge dans le palais voit xyz le texte. Xyzxyzxy la loi est claire.", "Le juge dans le palais voit que le texte. Toutefois la loi est claire."),
        ("The judge in the court sees abcd the text. Abcdefg the law is clear.", "The judge in the court sees that the text. However the law is clear."),
        ("El juez en la sala lee abc el texto del caso. Abcdef la ley es clara.", "El juez en la sala lee que el texto del caso. Además la ley es clara."),
        ("القاضي في المحكمة يرى سش النص. شسشسش القانون واضح.", "القاضي في المحكمة يرى أن النص. ولذلك القانون واضح."),
    ],
)
def test_links_count_in_each_language(plain, deep):
    a, b = (levels.features(t, {}, {}, 10.0, 3.0) for t in (plain, deep))
    gained = b - a
    assert gained[30] > 0 and gained[31] > 0 and gained[32] > 0 and len(a) == levels.WIDTH
    assert levels.features("", {}, {}, 10.0, 3.0).shape == a.shape


def test_relatives_and_depth():
    one = levels.links(levels._tokens("La loi qui est dans le code dont le juge parle, et que le roi signe.")[0])
    assert one[3] == 2 and one[2] == 1 and one[4] == 1 and one[5] == pytest.approx(np.log(4)) and one[6] == 1
    assert levels.links(levels._tokens("Le juge signe.")[0]) == [0.0] * 7


def test_calibrated_probabilities_are_right_as_often_as_they_say():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    z = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=1500)
    y = 1 + (z[:, None] > np.array([-2.0, -0.5, 0.5, 2.0])[None, :]).sum(1).astype(float)
    mean, scale, weights, cuts = levels.fit_ordinal(x[:1000], y[:1000])
    model = levels.Model(mean, scale, weights, cuts, {}, {}, 10.0, 3.0, levels.calibration(x[:1000], y[:1000]))
    p = model.probabilities(x[1000:])
    assert abs(p.max(1).mean() - (p.argmax(1) + 1 == y[1000:]).mean()) < 0.06
    assert levels.calibration(x[:0], y[:0]) == 1.0
    sharp = levels.calibration(rng.normal(size=(300, 40)), rng.integers(1, 6, 300).astype(float))
    assert sharp < 1  # chance fits are toned down


def test_quantiles():
    values = np.sort(np.random.default_rng(1).normal(size=17))
    assert levels._quantiles(values, (0.0, 0.1, 0.5, 1.0)) == pytest.approx(np.quantile(values, (0.0, 0.1, 0.5, 1.0)))
    assert levels._quantiles(values[:1], (0.3,)) == [values[0]]
