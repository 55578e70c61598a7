"""Element-wise algebra of fields: columns of one table, joined on the point only when stored apart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "rdiff": lambda a, b: F.try_divide(a, b) - 1,
    "radd": lambda a, b: (a + 1) * b,
    "divlog": lambda a, b: F.ln(F.try_divide(a, b)),
    "expmul": lambda a, b: F.exp(a) * b,
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "sqrt": F.sqrt,
    "zero": lambda a: F.lit(0.0),
    "one": lambda a: F.lit(1.0),
}
FUNCTIONS = frozenset("abs sqrt exp ln log10 pow sin cos tan least greatest coalesce nullif".split())


def field_expression(text: str, columns: list[str]) -> Column:
    """A user's formula over named columns: numbers, operators and a list of functions, nothing else."""
    if re.search(r"[^\w\s.+\-*/%(),<>=!]", text):
        raise ValueError(f"a character that is not allowed in {text!r}")
    for name in re.findall(r"(?<![\w.])[A-Za-z_]\w*", text):
        if name not in columns and name.lower() not in FUNCTIONS:
            raise ValueError(f"{name!r} is neither a column nor a function that is allowed")
    return F.expr(text)


def soft_clip(x: Column, limit: float, softness: float) -> Column:
    """x within the limit; beyond, a curve that nears (1 + softness) * limit."""
    return F.when(F.abs(x) > limit, x * (1 + softness) * limit / (F.abs(x) + softness * limit)).otherwise(x)


def clip(x: Column, low: Column, high: Column) -> Column:
    """Both sides; null stays null (least and greatest would skip it)."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def perturb(model: Column, change: Column, method: str, low: float | None = None, high: float | None = None) -> Column:
    """Apply a change once: absolute, relative or exponential, then clip."""
    if method == "absolute":
        new = model + change
    elif method == "relative":
        new = model * (1 + change)
    elif method == "exponential":
        new = model * F.exp(change)
    else:
        raise ValueError(f"unknown method {method!r}")
    return new if low is None else clip(new, F.lit(low), F.lit(high))


def water_level(kernel: Column, hessian: Column, largest: Column, level: float) -> Column:
    """Precondition by |h| relative to its largest, with a floor that keeps small h from blowing up."""
    return kernel * level / (hessian / largest + level)


def floored_inverse(hessian: Column, floor: Column) -> Column:
    return 1 / F.greatest(F.abs(hessian), floor)


def speed_ratio_floor(vp: Column, vs: Column, ratio: float) -> Column:
    """vs, lowered where vp / vs would be under the ratio."""
    return F.when(vp < ratio * vs, vp / ratio).otherwise(vs)


def voigt_from_anisotropic(vpv: Column, vph: Column, vsv: Column, vsh: Column) -> dict[str, Column]:
    """Isotropic averages and ratios: alpha, beta, phi (vph/vpv squared deviation), xi (vsh/vsv)."""
    return {
        "alpha": F.sqrt((vpv * vpv + 4 * vph * vph) / 5),
        "beta": F.sqrt((2 * vsv * vsv + vsh * vsh) / 3),
        "phi": vpv * vpv / (vph * vph),
        "xi": vsh * vsh / (vsv * vsv),
    }


def anisotropic_from_voigt(alpha: Column, beta: Column, phi: Column, xi: Column) -> dict[str, Column]:
    """The inverse of :func:`voigt_from_anisotropic`."""
    vph = alpha * F.sqrt(5 / (phi + 4))
    vsv = beta * F.sqrt(3 / (2 + xi))
    return {"vpv": vph * F.sqrt(phi), "vph": vph, "vsv": vsv, "vsh": vsv * F.sqrt(xi)}


def moment(tensor: Column) -> tuple[Column, Column]:
    """Scalar moment and magnitude of a 3x3 tensor given as an array of its nine elements."""
    m0 = F.sqrt(F.aggregate(tensor, F.lit(0.0), lambda a, x: a + x * x) / 2)
    return m0, (F.log10(m0) - 9.05) / 1.5


def relative_from_velocities(vpv: Column, vph: Column, vsv: Column, vsh: Column, vp0: Column, vs0: Column) -> dict[str, Column]:
    """alpha and beta (mean velocities relative to a reference), phi and xi (halved relative differences of
    squares) and kappa (ratio of the means). A mean is the root of the mean square."""
    vp2, vs2 = (vpv * vpv + vph * vph) / 2, (vsv * vsv + vsh * vsh) / 2
    return {
        "alpha": F.sqrt(vp2) / vp0 - 1, "beta": F.sqrt(vs2) / vs0 - 1, "phi": (vph * vph - vpv * vpv) / (2 * vp2),
        "xi": (vsh * vsh - vsv * vsv) / (2 * vs2), "kappa": F.sqrt(vp2 / vs2),
    }


def velocities_from_relative(alpha: Column, beta: Column, phi: Column, xi: Column, vp0: Column, vs0: Column) -> dict[str, Column]:
    """The inverse of :func:`relative_from_velocities`."""
    vp, vs = vp0 * (1 + alpha), vs0 * (1 + beta)
    return {"vpv": vp * F.sqrt(1 - phi), "vph": vp * F.sqrt(1 + phi), "vsv": vs * F.sqrt(1 - xi), "vsh": vs * F.sqrt(1 + xi)}


def velocities_from_ratio(beta: Column, kappa: Column, phi: Column, xi: Column, vs0: Column) -> dict[str, Column]:
    """As :func:`velocities_from_relative`, with the ratio kappa in place of alpha."""
    return velocities_from_relative(kappa - 1, beta, phi, xi, vs0 * (1 + beta), vs0)


def thomsen(vpv: Column, vph: Column, vsv: Column, vsh: Column, eta: Column | None = None) -> dict[str, Column]:
    """Weak-anisotropy parameters epsilon, gamma and, with eta, delta."""
    a, c, el, n = vph * vph, vpv * vpv, vsv * vsv, vsh * vsh
    out = {"epsilon": (a - c) / (2 * c), "gamma": (n - el) / (2 * el)}
    if eta is not None:
        f = eta * (a - 2 * el)
        out["delta"] = ((f + el) * (f + el) - (c - el) * (c - el)) / (2 * c * (c - el))
    return out


#: Places of the moduli in the upper triangle of a symmetric 6 x 6 matrix, by rows.
MODULI = {"11": 0, "12": 1, "13": 2, "22": 6, "23": 7, "33": 11, "44": 15, "55": 18, "66": 20}


def kernels_of_parameters(moduli: Column, density: Column, model: dict[str, Column], vp0: Column, vs0: Column) -> dict[str, Column]:
    """Kernels of (alpha, beta, phi, xi, eta, rho) from those of the moduli (array) and the density (per kg/m³).

    With A = rho·vp²·(1 + phi), C = rho·vp²·(1 - phi), L = rho·vs²·(1 - xi), N = rho·vs²·(1 + xi) and F = eta·(A - 2L),
    c11 = c22 = A, c33 = C, c12 = A - 2N, c13 = c23 = F, c44 = c55 = L and c66 = N: each kernel is the sum over
    the five of what a parameter does to them.
    """
    k = {n: F.get(moduli, F.lit(i)) for n, i in MODULI.items()}
    plane, tilt = k["13"] + k["23"], model["eta"]
    d = {  # kernels of the five moduli
        "A": k["11"] + k["22"] + k["12"] + tilt * plane, "C": k["33"], "L": k["44"] + k["55"] - 2 * tilt * plane, "N": k["66"] - 2 * k["12"],
    }
    vp, vs, rho, phi, xi = vp0 * (1 + model["alpha"]), vs0 * (1 + model["beta"]), model["rho"], model["phi"], model["xi"]
    p, s = vp * vp, vs * vs
    compression, shear = d["A"] * (1 + phi) + d["C"] * (1 - phi), d["L"] * (1 - xi) + d["N"] * (1 + xi)
    return {
        "alpha": 2 * rho * vp0 * vp * compression, "beta": 2 * rho * vs0 * vs * shear, "phi": rho * p * (d["A"] - d["C"]), "xi": rho * s * (d["N"] - d["L"]),
        "eta": rho * plane * (p * (1 + phi) - 2 * s * (1 - xi)), "rho": 1000 * density + p * compression + s * shear,
    }


def hessian_diagonal(kernels: Column, density: Column) -> Column:
    """An estimate of a Hessian's diagonal: the sum of squared kernels times the squared density."""
    return F.aggregate(kernels, F.lit(0.0), lambda a, x: a + x * x) * density * density


def depth_mask(depth: Column, none: float, full: float, kind: str = "cosine") -> Column:
    """0 above, 1 below, and a straight line or half a cosine between."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (depth - none) / (full - none)))
    return share if kind == "linear" else 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * share)


def random_perturb(x: Column, share: float, seed: int, *keys: Column) -> Column:
    """x changed by a uniform random share of at most ``share``, which follows from the row's keys and the seed,
    however rows are dealt."""
    if not keys:
        raise ValueError("the keys of a row are needed")
    uniform = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) / float(1 << 53)
    return x * (1 + share * (2 * uniform - 1))
