import math

import pytest

from evidentia.functions import expressions as E


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("q/r**k", "q/r**k", 1.0, 1.0),
        ("m*sqrt(u)/w**3", "n*sqrt(a)/b**3", 0.5, 1.0),
        ("7*t**4", "cos(s) - log(t)", 0.0, 0.4999),
        ("2", "3", 1.0, 1.0),
        ("broken((", "x", 0.0, 0.0),
    ],
)
def test_structural_score(a, b, low, high):
    assert low <= E.structural_score(a, b) <= high


def test_strict_structure_sees_values():
    assert E.structural_score("2", "3", strict=True) == 0.0


@pytest.mark.parametrize(("a", "b", "low", "high"), [("(u - 3)*(u + 3)", "u**2 - 9", 0.95, 1.0), ("sqrt(t)", "t**4", 0.0, 0.3), ("5", "5", 0.0, 0.0)])
def test_agreement(a, b, low, high):
    assert low <= E.agreement(a, b) <= high


def test_constants_can_agree():
    assert E.agreement("2", "4/2", constants=True) == 1.0 and E.agreement("(", "x") is None


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("(x+1)**2", "x**2 + 2*x + 1", True), ("x/y + 1", "(x + y)/y", True), ("2x y", "y*x*2", True), ("sqrt(x)**2", "x", True), ("sqrt(x**2)", "x", False), ("Rational(3,2)*x", "1.5*x", True), ("exp(x+y)", "exp(y+x)", True), ("1/(1/x)", "x", True), ("x**2", "x**3", False)],
)
def test_equal(a, b, same):
    assert E.equal(E.parse(a), E.parse(b)) is same


@pytest.mark.parametrize("text", [None, "", "  ", "((", "x +", "1 ** ", "$x", "f(x,,y)", "(" * 5000])
def test_unparsable_is_null(text):
    assert E.parse(text) is None and E.features(text) is None and E.fingerprint(text) is None and E.coefficients(text) == []


def test_parity():
    assert E.parity("x**2*y") == ["even_in_x", "homogeneous_in_x_deg_2.0", "odd_in_y", "homogeneous_in_y_deg_1.0"]
    assert E.parity("x + 1") == [] and E.parity("exp(x)*y") == ["odd_in_y", "homogeneous_in_y_deg_1.0"]


@pytest.mark.parametrize(
    ("text", "at", "want"),
    [("1/x", "0", "diverges"), ("1/x", "oo", "vanishes"), ("x**2 + 3", "0", "constant:3"), ("log(x)", "oo", "diverges"), ("x*y", "1", "finite"), ("x*y", "0", "vanishes"), ("exp(x)", "oo", "diverges")],
)
def test_limits(text, at, want):
    assert E.limit_behaviour(text, "x", at) == want


@pytest.mark.parametrize(("text", "want"), [("2", 2.0), ("Rational(3,2)", 1.5), ("-3*4", -12.0), ("2*x", None), ("sqrt(-1)", None), ("((", None), (None, None)])
def test_leading_coefficient(text, want):
    assert E.leading_coefficient(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"E = m c^2 = x", ("E", "m c^2 = x")), (r"a \equiv b", ("a", "b")), (r"S \sim A \approx B", ("S", r"A \approx B")), (r"x = y \quad \text{for } z = 1", ("x", "y")), (r"= b \approx c", ("= b", "c")), ("x", None), (None, None)],
)
def test_equality_sides(text, want):
    assert E.equality_sides(text) == want


def test_verification():
    assert E.verified("(x+1)**2", "x**2+2*x+1") is True and E.verified("x", "y") is None
    assert E.numerically_verified("x*x", "x**2") is True and E.numerically_verified("x", "x + 1") is False
    assert E.counterexample("x*y", "x*y + 1") is True and E.counterexample("x*y", "y*x") is False and E.counterexample("d", "2*x") is None


def test_embedding_has_84_finite_numbers(spark):
    from evidentia.plans.expressions import embedding

    rows = embedding(spark).collect()
    assert len(rows) == 12 and all(len(r.scaled) == 84 and all(map(math.isfinite, r.scaled)) for r in rows)


def test_skeletons_and_distance():
    assert E.skeleton(E.parse("A*x**2")) == E.skeleton(E.parse("B*y**3"))
    assert E.distance(E.parse("x + y"), E.parse("a + b")) == 0 and E.distance(E.parse("x"), E.parse("a + b")) == 3


@pytest.mark.parametrize("text", ["A/(4*G)", "x**2*(y + 1)", "sqrt(2)*exp(x/3) - 1", "-3/2*log(A/G)", "(a + b)**(1/2)/c", "2", "x"])
def test_infix_reads_back(text):
    e = E.parse(text)
    assert E.equal(E.parse(E.infix(e)), e)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("k*G + 2", "2", [("G", 0, 1.0)]), ("(G*x + 3*G)/(2*G)", "x/2 + 3/2", [("G", 0, 1.0)]), ("1/G", "1", []), ("log(G) + 1", "1", []), ("x**gamma_I", "x", [("gamma_I", 1, 1.0)]), ("hbar*w + l_P*v", "l_P*v", [("hbar", 0, 1.0)]), ("x", "x", []), ("(", "x", [])],
)
def test_limits(a, b, want):
    assert E.limit_matches(a, b) == want


def test_limit_score_is_of_either_side():
    assert E.limit_score("1", "1 + G") == 1.0 and E.limit_score("1", "x") is None


@pytest.mark.parametrize(("a", "b", "want"), [("x + y", "y + x", [("equal", 0.9)]), ("kappa*x", "sqrt(16*pi*G)*x", [("kappa_to_G", 0.85)]), ("u*v + w*z + 1", "w*z + u*v", [("near", 0.7)]), ("x", "y**3 + exp(z)", []), (None, "x", [])])
def test_substitution_levels(a, b, want):
    assert E.substitution_levels(a, b) == want
