"""Normal distribution functions as SQL text, for column expressions here and for SQL elsewhere.

Neither Spark nor plain SQL has an error function. Both functions are ratios of polynomials in
the published double-precision forms: Hart's for the distribution, Wichura's AS 241 for its
inverse. The text names its argument many times, so pass a column's name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients from the highest power down.
HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CENTRE_TOP = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRE_BOTTOM = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
MIDDLE_TOP = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_BOTTOM = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
TAIL_TOP = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
TAIL_BOTTOM = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)


def _number(x: float) -> str:
    return f"{x:.17e}"


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    text = _number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_number(c)})"
    return text


def normal_cdf_sql(x: str) -> str:
    """P(Z <= x)."""
    a = f"abs({x})"
    near = f"{_polynomial(HART_TOP, a)} / {_polynomial(HART_BOTTOM, a)}"
    far = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}e0 / {far})"
    upper = (
        f"(case when {a} > 37e0 then 0e0 else exp(-{x} * {x} / 2e0) * (case when {a} <"
        f" 7.07106781186547e0 then {near} else 1e0 / ({far} * 2.506628274631e0) end) end)"
    )
    return f"(case when {x} > 0e0 then 1e0 - {upper} else {upper} end)"


def normal_ppf_sql(p: str) -> str:
    """The x with P(Z <= x) = p; null outside (0, 1)."""
    q = f"({p} - 0.5e0)"
    square = f"(0.180625e0 - {q} * {q})"
    centre = f"{q} * {_polynomial(CENTRE_TOP, square)} / {_polynomial(CENTRE_BOTTOM, square)}"
    root = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    middle = f"{_polynomial(MIDDLE_TOP, f'({root} - 1.6e0)')} / {_polynomial(MIDDLE_BOTTOM, f'({root} - 1.6e0)')}"
    tail = f"{_polynomial(TAIL_TOP, f'({root} - 5e0)')} / {_polynomial(TAIL_BOTTOM, f'({root} - 5e0)')}"
    return (
        f"(case when {p} > 0e0 and {p} < 1e0 then case when abs({q}) <= 0.425e0 then {centre}"
        f" else sign({q}) * (case when {root} <= 5e0 then {middle} else {tail} end) end end)"
    )


def normal_cdf(x: str) -> Column:
    """P(Z <= x) of the column named ``x``."""
    return F.expr(normal_cdf_sql(x))


def normal_ppf(p: str) -> Column:
    """The inverse of :func:`normal_cdf` at the column named ``p``; null outside (0, 1)."""
    return F.expr(normal_ppf_sql(p))
