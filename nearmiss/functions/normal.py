"""Normal distribution as native expressions.

Spark has no error function; the rational approximations of Cody (1969) give
full double accuracy. The scaled complement erfcx keeps tails exact, so log
survival and Mills ratio need no special case far out.
"""
import math

from pyspark.sql import Column, DataFrame, functions as F

# Cody's coefficients, lowest degree of the numerator loop first.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
      1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
      4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
      1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: str, num, den) -> str:
    """Cody's nested form: the last numerator coefficient leads, the others follow in order."""
    top, bottom = f"{x} * {num[-1]!r}D", x
    for a, b in zip(num[:-2], den[:-1]):
        top, bottom = f"({top} + {a!r}D) * {x}", f"({bottom} + {b!r}D) * {x}"
    return f"(({top} + {num[-2]!r}D) / ({bottom} + {den[-1]!r}D))"


_LOG_PDF = f"(-n_z * n_z / 2 - {0.5 * math.log(2 * math.pi)!r}D)"
_TAIL = "0.5D * exp(-n_a * n_a) * n_ex"
_SF = f"CASE WHEN abs(n_x) <= 0.46875D THEN 0.5D - 0.5D * n_small WHEN n_x > 0 THEN {_TAIL} ELSE 1D - {_TAIL} END"
_CDF = f"CASE WHEN abs(n_x) <= 0.46875D THEN 0.5D + 0.5D * n_small WHEN n_x > 0 THEN 1D - {_TAIL} ELSE {_TAIL} END"
_FAR = "n_x > 0.46875D"
_FORMS = {
    "sf": _SF,
    "cdf": _CDF,
    "log_sf": f"CASE WHEN {_FAR} THEN -n_a * n_a + ln(0.5D * n_ex) ELSE log1p(-({_CDF})) END",
    "log_pdf": _LOG_PDF,
    "mills": f"CASE WHEN {_FAR} THEN {math.sqrt(2 / math.pi)!r}D / n_ex ELSE exp({_LOG_PDF}) / ({_SF}) END",
}


def with_normal(df: DataFrame, z: Column, **forms: str) -> DataFrame:
    """Add functions of a standard normal at z: name="sf" | "cdf" | "log_sf" | "log_pdf" | "mills".

    Shared terms are projected first, so the generated code stays small. NULL
    in, NULL out; sf and log_sf are accurate far into the tail.
    """
    steps = [
        {"n_z": z},
        {"n_x": F.expr(f"n_z / {math.sqrt(2.0)!r}D")},
        # greatest() skips NULL, so a missing z is restored at the end.
        {"n_a": F.expr("greatest(abs(n_x), 0.46875D)"), "n_small": F.expr(f"CASE WHEN abs(n_x) <= 0.46875D THEN n_x * n_x END")},
        {"n_y": F.expr("1D / (n_a * n_a)"), "n_small": F.expr(f"n_x * {_ratio('n_small', _A, _B)}")},
        {"n_ex": F.expr(f"CASE WHEN n_a <= 4D THEN {_ratio('n_a', _C, _D)} ELSE ({1 / math.sqrt(math.pi)!r}D - n_y * {_ratio('n_y', _P, _Q)}) / n_a END")},
        {name: F.expr(f"CASE WHEN n_z IS NOT NULL THEN {_FORMS[form]} END") for name, form in forms.items()},
    ]
    for s in steps:
        df = df.withColumns(s)
    return df.drop("n_z", "n_x", "n_a", "n_small", "n_y", "n_ex")


def quantile(p: float) -> float:
    """z with P(Z <= z) = p, for constant levels."""
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)
